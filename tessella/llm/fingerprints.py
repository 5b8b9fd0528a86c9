"""Document fingerprints: MinHash over word shingles.

A fingerprint is the high half of the minimum of each of PERMUTATIONS universal hash functions over a text's shingles, in
hex. Equal values of two fingerprints are counted as their likeness. groups joins fingerprints by bands in Spark and verifies
pairs by the Jaccard similarity of their full shingle sets.

Defined results: a null text is empty. A text of fewer words than a shingle has its whole sequence as one; one without
words has none, and its fingerprint, all ones, is like itself alone. Equal texts have equal fingerprints. Rows that repeat
are kept. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored, text_or_empty
from tessella.llm.linking import Classes
from tessella.llm.textarrays import Permutations, distinct, lists, members_of, mix, runs, set_hashes, texts, words

#: Bands of 6 miss a pair at similarity 0.8 with a probability of 0.002; those of groups are of 4: under 1e-7.
PERMUTATIONS = 128
ROWS = 4
SHINGLE = 5
#: Rows of which a task works off fingerprints at once.
BATCH_CHARS = 2_000_000


def minima(column: pa.Array, shingle: int) -> np.ndarray:
    """(text, function): the high halves of the minima."""
    family, out = Permutations(PERMUTATIONS, seed=2), []
    for _, _, data, at in texts(column):
        hashed, _, first = runs(words(data, at, lower=True), shingle, short=True)
        out.append((family.minima(hashed, first) >> np.uint64(32)).astype(">u4"))
    return np.concatenate(out) if out else np.zeros((0, PERMUTATIONS), dtype=">u4")


def hexed(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint of each of documents."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                marks = hexed(minima(part.column("text"), shingle))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about BATCH_CHARS."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy())
    row = 0
    while row < batch.num_rows:
        before = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, before + BATCH_CHARS, side="right")))
        yield batch.slice(row, end - row)
        row = end


def with_next(documents: DataFrame) -> DataFrame:
    """Ranges of documents in descending doc_id: (range, last, doc_id, text), each range sorted within one partition.

    Each range ends with a copy of the first row of the next one (last is true), the lowest with one of the first row of
    all, so that each row's successor is in its partition. The cuts between ranges are approximate quantiles of doc_id; one
    for each shuffle partition goes through the driver. Rows that share a doc_id are in the order of their texts; those
    without one come last.
    """
    spark = documents.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(documents.stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)))
    rows = documents.select(F.lit(False).alias("last"), "doc_id", "text", F.col("doc_id").cast("double").alias("_id"))
    number = F.lit(0)
    if cuts:
        rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_bucket", handleInvalid="keep").transform(rows)
        number = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(len(cuts) - F.col("_bucket")).cast("int")
    rows = rows.select(number.alias("range"), "last", "doc_id", "text")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", text_or_empty().alias("text"))
    heads = stored(rows.groupBy("range").agg(F.max(order).alias("head")), "heads")  # a row for each range
    order = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy()))
    copies = heads.select(before.alias("range"), F.lit(True).alias("last"), "head.doc_id", "head.text")
    every = rows.unionByName(copies).repartitionByRange(n, "range")
    return every.sortWithinPartitions("range", "last", F.desc_nulls_last("doc_id"), F.desc(text_or_empty()))


def edited_likeness(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """For each of documents its fingerprint, that of its edited text, and their likeness to one another and to the next one's.

    The edited text has its last third replaced by as much of the next document, in descending doc_id and around.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in batches:
            for part in _parts(batch):
                whole = pa.Table.from_batches([part])
                if pending is not None:
                    whole = pa.concat_tables([pending, whole])
                whole = whole.combine_chunks()
                yield from pairs(whole)
                pending = whole.slice(len(whole) - 1)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = [t or "" for t in rows.column("text").to_pylist()]
        ranges, last = rows.column("range").to_pylist(), rows.column("last").to_pylist()
        at = np.array([i for i in range(len(own) - 1) if not last[i]], dtype=np.int64)
        if not len(at):
            return
        if any(ranges[i] != ranges[i + 1] for i in at):
            raise ValueError("a range without its end")
        marks = minima(pa.array(own, pa.string()), shingle)
        edited = [own[i][: len(own[i]) - len(own[i]) // 3] + own[i + 1][: len(own[i]) // 3] for i in at]
        changed = minima(pa.array(edited, pa.string()), shingle)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").combine_chunks().take(pa.array(at)), pa.array([len(own[i]) for i in at], pa.int64()),
                pa.array(edited, pa.string()), pa.array(hexed(marks[at]), pa.string()), pa.array(hexed(changed), pa.string()),
                pa.array((marks[at] == changed).mean(axis=1)), pa.array((marks[at] == marks[at + 1]).mean(axis=1)),
            ],
            names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(documents).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _identities(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Permutations(PERMUTATIONS, seed=2)
        for batch in batches:
            for row, end, data, at in texts(batch.column("text")):
                hashed, _, first = runs(words(data, at, lower=True), shingle, short=True)
                least = family.minima(hashed, first) >> np.uint64(32)
                keys = np.zeros((end - row, PERMUTATIONS // ROWS), dtype=np.uint64)
                for k in range(ROWS):
                    keys = mix(keys ^ least[:, k::ROWS])
                keys = mix(keys + np.arange(PERMUTATIONS // ROWS, dtype=np.uint64))
                sets = distinct(hashed, first)
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                sums = set_hashes(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, end - row), pa.array(sizes), *map(pa.array, sums),
                        lists([k if len(x) else k[:0] for k, x in zip(keys, sets, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "n", "set_1", "set_2", "bands"],
                )

    return run


def similar_classes(documents: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> Classes:
    """Classes of equal shingle sets, whose links() are verified by 100 * intersection >= percent * union of the sets.

    Bands of ROWS minima are joined in Spark. Copies are not expanded into pairs: components of links are those of all similar
    pairs that share a band.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    marks = documents.select("doc_id", "text").mapInArrow(_identities(shingle), f"doc_id {kind}, n long, set_1 long, set_2 long, bands array<long>")
    marks = stored(marks.withColumn("sig", F.array().cast("array<long>")), "identities")
    return Classes(documents, marks, members_of(shingle), lambda a, b: "true", percent)


def groups(documents: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id and group_id, the smallest doc_id reachable by similar pairs; texts without words are alone, rows without a doc_id in no group."""
    found = similar_classes(documents, shingle, percent).groups()
    return found.select("doc_id", F.when(F.col("n") > 0, F.col("group")).otherwise(F.col("doc_id")).alias("group_id"))
