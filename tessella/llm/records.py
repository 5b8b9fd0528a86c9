"""Token ids in length-delimited binary files, with an offset index for shuffled reads.

A file is a run of records: the length of the payload (8 bytes), the masked checksum of these 8 bytes (4), the payload, and
its masked checksum (4), all little-endian. A checksum is a crc32, turned right by 15 bits, plus MASK. A payload is a byte
of flags (1: ids of 4 bytes, else of 2; 2: the document has no id), the document's id (8 bytes) and its token ids. Empty
records end each block of records and carry nothing. Documents are in ascending order of doc_id over the files, in the order
of the two numbers in their names, those without an id first, and those that share an id by text.

The files are written by Spark's own writer, so any file system that Spark knows does, and failed tasks leave nothing. The
index has, for each document, its file, the offset and length of its record, and its place among all token ids.

Defined results: a null text is empty, and its record has the end id alone. Rows that repeat have a record each. doc_id is
an integer. Other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_small
from tessella.llm.textarrays import release_memory

MASK = 0xA282EAD8
#: Bytes of records after which a block ends; distinct parts of texts whose ids a task keeps, in each of two generations.
BLOCK, CACHE = 4 << 20, 600_000
#: Blocks after which a task goes on in another file, so that files are of about 64 MB.
FILE_BLOCKS = 16
#: Documents that are encoded at once; files that a task reading by offset keeps open.
ROWS, OPEN_FILES = 512, 64
#: The numbers of the task and of its file in the names that Spark gives.
FILE_NUMBERS = r"part-(\d+)-[^/]*-c(\d+)[^/]*$"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def record(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join([head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))])


EMPTY = record(b"")


class Encoder:
    """A byte-level BPE tokenizer that splits at spaces. Parts of texts between spaces are encoded once while kept.

    A text with a space beside other white space, or at an end, is encoded whole, and so is one with an added token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.lengths = np.zeros(size, dtype=np.int64)
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(token)  # byte-level tokens are spelled with a character for each byte
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: Iterable[str]) -> None:
        """Encode new parts, joined by the spaces that they stand after, and keep their ids.

        A part that is empty or has white space at an end gets None: beside a space, that would split otherwise.
        """
        old = self.old
        self.parts.update((p, old[p]) for p in parts if p in old)
        new = [p for p in parts if p not in old]
        bad = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        self.parts.update(dict.fromkeys(bad))
        new = list(set(new).difference(bad)) if bad else new
        if new:
            joined = " " + " ".join(new)
            ids = np.array(self.ids([joined])[0])
            starts = np.flatnonzero(np.frombuffer(joined.encode(), dtype=np.uint8) == 32)
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), starts[1:], side="right") * self.dtype.itemsize
            data = ids.astype(self.dtype).tobytes()
            bounds = [0, *cuts.tolist(), len(data)]
            self.parts.update(zip(new, map(data.__getitem__, map(slice, bounds[:-1], bounds[1:])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self.parts) > CACHE:
            self.parts, self.old = {}, self.parts
        cut = [t.split(" ") for t in texts]
        heads = [parts.pop(0) for parts in cut]
        self._learn(set().union(*cut).difference(self.parts))
        known, out = self.parts.__getitem__, []
        for head, ids, parts in zip(heads, self.ids(heads), cut, strict=True):
            try:
                out.append(b"".join([np.array(ids, dtype=self.dtype).tobytes(), *map(known, parts)]))
            except TypeError:  # a None among them
                out.append(None)
        for i, (text, head, parts) in enumerate(zip(texts, heads, cut, strict=True)):
            uneven = parts and (not head or head[-1].isspace())
            if out[i] is None or uneven or any(t in text for t in self.added):
                out[i] = np.array(self.ids([text])[0], dtype=self.dtype).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(documents: DataFrame, tokenizer: str, end_id: int, path: str, file_blocks: int = FILE_BLOCKS) -> None:
    """Encode all documents and write their records to files under path, each of file_blocks blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, size = encoder(tokenizer), [], 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        wide = enc.dtype.itemsize == 4
        for batch in batches:
            for row in range(0, batch.num_rows, ROWS):
                part = batch.slice(row, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                    head = struct.pack("<Bq", wide | (doc_id is None) << 1, doc_id or 0)
                    block.append(record(head + ids + end))
                    size += len(block[-1])
                if size >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)], pa.binary())], names=["value"])
                    block, size = [], 0
        enc.old = {}
        release_memory()
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)], pa.binary())], names=["value"])

    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    blocks.write.option("maxRecordsPerFile", file_blocks).option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def parse(content: memoryview) -> Iterator[tuple[int, memoryview]]:
    """The offset and payload of each record but the empty ones. Raises on a wrong checksum or a cut file."""
    at = 0
    while at < len(content):
        head = content[at : at + 8]
        (size,) = struct.unpack("<Q", head)
        if struct.unpack("<I", content[at + 8 : at + 12])[0] != masked(head):
            raise ValueError(f"wrong checksum of the length at {at}")
        payload = content[at + 12 : at + 12 + size]
        if struct.unpack("<I", content[at + 12 + size : at + 16 + size])[0] != masked(payload):
            raise ValueError(f"wrong checksum of the record at {at}")
        if size:
            yield at, payload
        at += 16 + size


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """The document's id and its token ids."""
    flags, doc_id = struct.unpack("<Bq", payload[:9])
    return None if flags & 2 else doc_id, np.frombuffer(payload[9:], dtype="<u4" if flags & 1 else "<u2")


INDEX = "file string, offset long, length long, doc_id long, start long, n_tokens long, ids_crc32 long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows, start = [], 0
            for offset, payload in parse(memoryview(content.as_buffer())):
                doc_id, ids = unpack(payload)
                rows.append((path, offset, len(payload) + 16, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            names = [c.split()[0] for c in INDEX.split(", ")]
            kinds = [pa.string(), *[pa.int64()] * 6]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def offset_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: one row for each record, as INDEX; start counts the token ids of all records before it."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    index = files.mapInArrow(_index, INDEX)
    index.write.parquet(f"{path}-index")
    index = spark.read.schema(INDEX).parquet(f"{path}-index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = F.sum("n").over(Window.orderBy(*file_order()).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return index.join(broadcast_if_small(totals), "file").withColumn("start", F.col("start") + F.col("before")).drop("before")


def file_order() -> list[Column]:
    """Numbers by which files (file) come in the order of their documents."""
    return [F.regexp_extract("file", FILE_NUMBERS, k).cast("long") for k in (1, 2)]


def read_shuffled(spark: SparkSession, index: DataFrame, seed: int) -> DataFrame:
    """(place, doc_id, ids): the records of index in an order drawn from seed, sorted by place over all partitions.

    Only the records themselves are read: a task opens the files that its records are in and seeks each by its offset, in the
    order of offsets within a batch. The files' system has to be one that pyarrow knows.
    """
    place = F.xxhash64(F.lit(seed), "file", "offset")
    rows = index.select(place.alias("place"), "file", "offset", "length").orderBy("place", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=OPEN_FILES)
        def opened(file: str) -> pa.NativeFile:
            system, name = pa.fs.FileSystem.from_uri(file.replace("file:/", "file:///") if file.startswith("file:/") and file[6] != "/" else file)
            return system.open_input_file(name)

        for batch in batches:
            wanted = list(zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True))
            found: list = [None] * len(wanted)
            for k in sorted(range(len(wanted)), key=wanted.__getitem__):
                file, offset, length = wanted[k]
                found[k] = unpack(next(parse(memoryview(opened(file).read_at(length, offset))))[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("place"), pa.array([d for d, _ in found], pa.int64()),
                    pa.array([i.astype(np.int64) for _, i in found], pa.list_(pa.int64())),
                ],
                names=["place", "doc_id", "ids"],
            )

    return rows.mapInArrow(run, "place long, doc_id long, ids array<long>")
