"""b-bit MinHash near-duplicate groups.

Each text's word shingles are hashed by PERMUTATIONS universal functions. The full minima give the keys of the bands, by
which candidates meet. Of each minimum only BITS low bits are kept in a packed signature: equal bits of a candidate pair,
counted and corrected for chance collisions, estimate its similarity, and pairs that are far below the threshold go. The
others are confirmed on their full shingle sets. With ROWS rows in a band, a pair at similarity 0.8 shares none of the
BANDS bands with a probability below 1e-6, and the estimate drops it with one below 1e-10.

Defined results: texts without words, or null, have an empty set and are linked with nothing. A text of fewer words than
a shingle has its whole sequence as one. Rows that repeat a doc_id are one node, linked by any of their texts. A null
doc_id is linked with nothing: it has a null component and is kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_small, free_name, stored
from tessella.llm.linking import Classes
from tessella.llm.textarrays import Permutations, distinct, lists, members_of, mix, release_memory, runs, set_hashes, texts, words

ROWS, BANDS, BITS = 6, 48, 4
PERMUTATIONS = ROWS * BANDS
#: Standard errors below the threshold at which a pair's estimate rules it out.
SLACK = 7

SIGNATURES = "doc_id {kind}, n long, set_1 long, set_2 long, bands array<long>, sig array<long>"


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Permutations(PERMUTATIONS)
        for batch in batches:
            for row, end, data, at in texts(batch.column("text")):
                hashed, _, first = runs(words(data, at, lower=True), shingle, short=True)
                sets = distinct(hashed, first)
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                every = np.concatenate(sets)
                minima = family.minima(every, first)
                sums = set_hashes(every, first)
                keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    keys = mix(keys ^ minima[:, k::ROWS])
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
                low = (mix(minima) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
                packed = np.ascontiguousarray((low[:, ::2] << 4) | low[:, 1::2])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, end - row), pa.array(sizes),
                        *map(pa.array, sums),
                        lists([k if n else k[:0] for k, n in zip(keys, sizes, strict=True)], pa.int64()), lists(list(packed.view(np.int64)), pa.int64()),
                    ],
                    names=["doc_id", "n", "set_1", "set_2", "bands", "sig"],
                )
        release_memory()

    return run


def signatures(documents: DataFrame, shingle: int = 5) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_signatures(shingle), SIGNATURES.format(kind=kind))


def similarity(a: str, b: str) -> str:
    """SQL for the collision-corrected estimate from the packed signatures of two rows.

    A function's two minima agree in BITS bits with probability s + (1 - s) / 2**BITS. A half-byte of the exclusive or is
    nought where they agree; those that are not are counted by folding their bits to one.
    """
    fold = "shiftright(x ^ y, 1) | shiftright(x ^ y, 2) | shiftright(x ^ y, 3)"
    differ = f"aggregate(zip_with(sig_{a}, sig_{b}, (x, y) -> bit_count((x ^ y | {fold}) & {0x1111111111111111}L)), 0, (t, d) -> t + d)"
    return f"((1 - {differ} / {PERMUTATIONS}) - 1 / {1 << BITS}) / (1 - 1 / {1 << BITS})"


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each of documents: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    threshold = percent / 100
    spread = (threshold * (1 - threshold) / PERMUTATIONS) ** 0.5
    likely = lambda a, b: f"{similarity(a, b)} >= {threshold - SLACK * spread}"
    found = stored(signatures(documents, shingle), "signatures")
    out = Classes(documents, found, members_of(shingle), likely, percent).groups()
    component = F.when(F.col("n") > 0, F.col("group")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without those that have a near copy with a smaller doc_id in their group.

    Of rows that repeat a kept doc_id, one stays.
    """
    own = free_name("_gone", documents)
    gone = near_duplicates(documents, shingle, percent).filter("not kept").select(F.col("doc_id").alias(own)).distinct()
    left = documents.join(broadcast_if_small(stored(gone, "gone")), F.col("doc_id") == F.col(own), "left_anti")
    nameless = left.filter("doc_id is null")
    return left.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(nameless)
