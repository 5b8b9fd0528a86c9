"""Token counts of sections and fields, from one encoding of the whole document.

A document is encoded once, as a whole. Its tokens' spans follow from the lengths of the tokens' bytes, and are joined to
the spans of its sections by binary search over their sorted ends. A token that crosses boundaries belongs to the section
that it starts in (rule "start"), ends in ("end"), or has most bytes in, the first of these ("most"). So counts add up to
the document's.

Sections are lines, each with its line end; fields are columns, joined by a separator that belongs to the field before it.
Spans are given in code points, ends exclusive; a token of part of a character counts as within it.

Defined results: a null text is empty, and has no sections and no tokens. Null fields are empty and have a count of their
own. Rows that repeat are counted each. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.textarrays import texts

RULES = ("start", "end", "most")
FIELD_END = "\n"


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a file of ranks, and the lengths of its tokens in bytes."""
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
    for token, i in table.items():
        lengths[i] = len(token)
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """The tokens of each section, and how many tokens cross a boundary. Both ends are ascending, over the same bytes."""
    if not len(token_ends):
        return np.zeros(len(section_ends), dtype=np.int64), 0
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    owner = last if rule == "end" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        section_starts = np.concatenate([[0], section_ends[:-1]])
        for t in crossing:
            parts = range(first[t], last[t] + 1)
            share = [min(token_ends[t], section_ends[s]) - max(starts[t], section_starts[s]) for s in parts]
            owner[t] = first[t] + int(np.argmax(share))
    return np.bincount(owner, minlength=len(section_ends)), len(crossing)


def line_ends(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(data) == 0 or len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def _counts(ranks: str, pattern: str, rule: str, ends_of: Callable[[np.ndarray, dict], np.ndarray], extra: list[str]):
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(ranks, pattern)
        for batch in batches:
            for row, end, data, at in texts(batch.column("text")):
                part = batch.slice(row, end - row)
                more = [dict(zip(extra, x, strict=True)) for x in zip(*[part.column(c).to_pylist() for c in extra], strict=True)] if extra else [{}] * (end - row)
                n_tokens, n_crossing, tokens, ends = [], [], [], []
                for i in range(end - row):
                    own = data[at[i] : at[i + 1]]
                    sections = ends_of(own, more[i])
                    ids = enc.encode_to_numpy(own.tobytes().decode(), disallowed_special=()) if len(own) else np.zeros(0, dtype=np.int64)
                    counts, crossing = allocate(np.cumsum(lengths[ids]), sections, rule)
                    chars = np.cumsum((own & 0xC0) != 0x80)
                    n_tokens.append(len(ids))
                    n_crossing.append(crossing)
                    tokens.append(counts)
                    ends.append(chars[sections - 1] if len(own) else np.zeros(len(sections), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_crossing, pa.int64()),
                        pa.array(tokens, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_tokens", "n_crossing", "section_tokens", "section_ends"],
                )

    return run


OUT = "doc_id {kind}, n_tokens long, n_crossing long, section_tokens array<int>, section_ends array<int>"


def line_tokens(documents: DataFrame, ranks: str, pattern: str, rule: str = "start") -> DataFrame:
    """A row for each of documents, as OUT: its tokens, those that cross line ends, and each line's tokens and end."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    run = _counts(ranks, pattern, rule, lambda data, _: line_ends(data), [])
    return documents.select("doc_id", "text").mapInArrow(run, OUT.format(kind=kind))


def field_tokens(rows: DataFrame, fields: list[str], ranks: str, pattern: str, rule: str = "start") -> DataFrame:
    """The same for the string columns fields, in this order, as the sections of one text."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = [F.concat(F.coalesce(f, F.lit("")), F.lit(FIELD_END if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    sizes = F.array(*[F.octet_length(p) for p in parts])
    joined = rows.select("doc_id", F.concat(*parts).alias("text"), sizes.alias("_sizes"))  # no other column, so no name clashes
    run = _counts(ranks, pattern, rule, lambda _, more: np.cumsum(more["_sizes"]), ["_sizes"])
    return joined.mapInArrow(run, OUT.format(kind=kind))


def per_section(counted: DataFrame) -> DataFrame:
    """doc_id, section (from 0), start, end and n_tokens: a row for each section."""
    zipped = F.posexplode(F.arrays_zip("section_tokens", "section_ends")).alias("section", "s")
    out = counted.select("doc_id", "section_ends", zipped)
    start = F.when(F.col("section") == 0, 0).otherwise(F.try_element_at("section_ends", F.col("section")))
    return out.select("doc_id", "section", start.alias("start"), F.col("s.section_ends").alias("end"), F.col("s.section_tokens").alias("n_tokens"))
