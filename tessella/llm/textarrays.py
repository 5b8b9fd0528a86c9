"""Words and shingles of many texts at once, as numpy arrays.

Texts come as Arrow columns. They are worked off in blocks of about half a megabyte, so memory does not grow with a batch. Words
are runs of bytes other than ASCII white space. Hashes are polynomials modulo 2**64, mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 19
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {}


def release_memory() -> None:
    """At the end of a task: hand unused memory back, as the worker may wait, or go on with something else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, BLOCK), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: first row, last row (exclusive), their bytes, and where each begins and the last ends. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


@dataclass
class Words:
    """The words of a block: where each starts and ends in the bytes, its hash, and at which word each text begins."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, at: np.ndarray, lower: bool) -> Words:
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~SPACE[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * powers(INVERSE, len(data) + 1)[start])
    return Words(start, end, hashed, np.searchsorted(start, at))


def runs(w: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, the word each starts at, and at which run each text begins.

    short: a text of fewer words than k, but of some, has its whole sequence as one run.
    """
    n = len(w.hash)
    left = np.repeat(w.first[1:], w.counts) - np.arange(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(w.hash * powers(BASE, n), out=sums[1:])
    length = np.minimum(left, k)
    keep = left >= k
    if short:
        few = (w.counts > 0) & (w.counts < k)
        keep[w.first[:-1][few]] = True
    at = np.flatnonzero(keep)
    length = length[at]
    hashed = (sums[at + length] - sums[at]) * powers(INVERSE, n + 1)[at] + length.astype(np.uint64)
    return mix(hashed), at, np.searchsorted(at, w.first)


def distinct(hashed: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    return [np.unique(hashed[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


class Permutations:
    """Universal hash functions x -> a*x + b modulo 2**64 with odd a, drawn from a fixed seed."""

    def __init__(self, n: int, seed: int = 1):
        draws = np.random.default_rng(seed).integers(0, 1 << 64, size=(2, n), dtype=np.uint64)
        self.a, self.b = draws[0] | np.uint64(1), draws[1]

    def minima(self, hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The least value of each function over each text's hashes; all ones for a text without any."""
        out = np.full((len(first) - 1, len(self.a)), np.iinfo(np.uint64).max, dtype=np.uint64)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            starts = first[:-1][some]
            for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                out[some, k] = np.minimum.reduceat(hashed * a + b, starts)
        return out


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind))


def set_hashes(every: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that tell sets apart, of the distinct hashes of each text."""
    out = []
    for values in (every, mix(every)):
        sums = np.zeros(len(every) + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def members_of(shingle: int) -> Callable[[DataFrame], DataFrame]:
    """Gives (id, members), the distinct shingles, of rows (id, n, set_1, set_2, text) whose text has the set so described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [batch.column(c).to_numpy() for c in ("n", "set_1", "set_2")]
            for row, end, data, at in texts(batch.column("text")):
                hashed, _, first = runs(words(data, at, lower=True), shingle, short=True)
                sets = distinct(hashed, first)
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                sums = set_hashes(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
                own = np.logical_and.reduce([k[row:end] == x for k, x in zip(known, (sizes, *sums), strict=True)])
                ids = batch.column("id").slice(row, end - row).filter(pa.array(own))
                yield pa.RecordBatch.from_arrays([ids, lists([x for x, o in zip(sets, own, strict=True) if o], pa.int64())], names=["id", "members"])
        release_memory()

    return lambda rows: rows.mapInArrow(run, "id long, members array<long>")
