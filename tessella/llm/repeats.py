"""Substring dedup with repeated-phrase automata.

A passage is WINDOW consecutive words. Phrases of PHRASE words are chosen by content: of all phrases within a window, the
one with the least hash, so that equal windows choose equal phrases. Phrases that texts other than copies of one text share
are confirmed as recurring, and spelled once, from one of their texts, as codes of their words. An Aho-Corasick automaton over
these codes then finds every occurrence: phrases are dealt to the documents that may hold them, and each shard, the phrases of a
block of documents, is compiled and has the words of all texts of the block streamed through it. So a shard's memory is
bounded by its block, each text is read once, and a text meets no phrase that it cannot have; shards of phrases alone would have
to see every text each. What the automaton finds decides which windows are compared, by a 96-bit hash of their words,
over all documents; a word goes if a window over it also starts in a document with a smaller doc_id.

Copies of a whole text need no search: all but the one with the smallest doc_id lose every word, if they have a window.

Defined results: a null text has no words. Rows that repeat a doc_id are one document, whose windows count for none of
these rows; each is cut by itself. Rows without a doc_id come after all others and lose nothing to one another; copies of a
text among them are treated alike. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_small, row_key, stored
from tessella.llm.textarrays import Words, lists, mix, runs, texts, words

WINDOW, PHRASE = 50, 10
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def chosen(w: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word at which each window starts, the word at which its chosen phrase starts, and all phrases' hashes by word."""
    hashed, at, _ = runs(w, phrase, short=False)
    by_word = np.full(len(w.hash), np.iinfo(np.uint64).max, dtype=np.uint64)
    by_word[at] = hashed
    _, starts, _ = runs(w, window, short=False)
    span = window - phrase + 1
    if not len(starts):
        return starts, starts, by_word
    # The least hash of span phrases, by blocks: suffix minima of one block and prefix minima of the next.
    n = len(by_word)
    padded = np.full(-(-n // span) * span + span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = by_word
    blocks = padded.reshape(-1, span)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(suffix[starts], prefix[starts + span - 1])
    # Its place: the next word at or after the start with that hash. Equal windows have it at equal places.
    order = np.argsort(by_word, kind="stable")
    place = _next_place(by_word, order, least, starts)
    return starts, place, by_word


def _next_place(by_word: np.ndarray, order: np.ndarray, least: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ranked = by_word[order]
    place = order[np.searchsorted(ranked, least)]
    late = np.flatnonzero(place < starts)  # the hash occurs more than once
    for i in late:
        a, b = np.searchsorted(ranked, least[i], side="left"), np.searchsorted(ranked, least[i], side="right")
        same = order[a:b]
        place[i] = same[np.searchsorted(same, starts[i])]
    return place


def _survey(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, at in texts(batch.column("text")):
                w = words(data, at, lower=False)
                starts, place, by_word = chosen(w, window, phrase)
                picked = np.unique(place)
                cuts = np.searchsorted(picked, w.first)
                keys = [np.unique(by_word[picked[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                seqs, kept = [], []
                for i in range(end - row):
                    own = b" ".join(WORDS.findall(data[at[i] : at[i + 1]].tobytes()))
                    kept.append(hashlib.sha256(own).hexdigest())
                    seqs.append(int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_key").slice(row, end - row), batch.column("doc_id").slice(row, end - row), pa.array(seqs, pa.int64()), pa.array(w.counts.astype(np.int64)),
                        pa.array(kept, pa.string()), lists(keys, pa.int64()),
                    ],
                    names=["row_key", "doc_id", "text_key", "n_words", "whole_sha256", "phrases"],
                )

    return run


def _codes(w: Words) -> np.ndarray:
    """A number of 32 bits for each word. Words that share one make the automaton find too much, which the windows' hashes tell."""
    return (w.hash >> np.uint64(32)).astype(np.uint32)


def _spell(window: int, phrase: int):
    """(phrase, codes) of the phrases that each row is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("phrases")
            for row, end, data, at in texts(batch.column("text")):
                w = words(data, at, lower=False)
                _, place, by_word = chosen(w, window, phrase)
                wanted = np.unique(np.concatenate([asked[i].values.to_numpy(zero_copy_only=False) for i in range(row, end)]).view(np.uint64))
                place = np.unique(place)
                place = place[np.isin(by_word[place], wanted)]
                names, once = np.unique(by_word[place], return_index=True)
                codes = _codes(w).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), lists([codes[i : i + phrase] for i in place[once]], pa.int32())], names=["phrase", "codes"]
                )

    return run


def automaton_of(phrases: np.ndarray) -> ahocorasick.Automaton:
    """For sequences of codes: a row for each phrase."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for codes in phrases.tolist():
        automaton.add_word(tuple(codes), 1)
    automaton.make_automaton()
    return automaton


def _locate(window: int, phrase: int):
    """Windows (h1, h2) whose chosen phrase the automaton of their block finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recurring = batch.column("codes")
            for row, end, data, at in texts(batch.column("text")):
                w = words(data, at, lower=False)
                shard = np.concatenate([recurring[i].values.to_numpy(zero_copy_only=False) for i in range(row, end)])
                automaton, hit = automaton_of(np.unique(shard.view(np.uint32).reshape(-1, phrase), axis=0)), np.zeros(len(w.hash), dtype=bool)
                codes = tuple(_codes(w).tolist())
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    if b - a >= window:
                        hit[[a + last - phrase + 1 for last, _ in automaton.iter(codes[a:b])]] = True
                starts, place, _ = chosen(w, window, phrase)
                use = starts[hit[place]] if len(starts) else starts
                h1, h2 = _window_hashes(w, use, window)
                cuts = np.searchsorted(use, w.first)
                for i in range(end - row):
                    a, b = cuts[i], cuts[i + 1]
                    if a < b:
                        _, once = np.unique(h1[a:b], return_index=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.repeat(batch.column("row_key")[row + i], len(once)), pa.repeat(batch.column("doc_id")[row + i], len(once)),
                                pa.array(h1[a:b][once].view(np.int64)), pa.array(h2[a:b][once].astype(np.int32)),
                            ],
                            names=["row_key", "doc_id", "h1", "h2"],
                        )

    return run


def _window_hashes(w: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    every, at, _ = runs(w, window, short=False)
    first = every[np.searchsorted(at, starts)] if len(starts) else every[:0]
    other, at, _ = runs(Words(w.start, w.end, mix(w.hash + np.uint64(0x5851F42D4C957F2D)), w.first), window, short=False)
    second = other[np.searchsorted(at, starts)] if len(starts) else other[:0]
    return first, second >> np.uint64(33)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = batch.column("removed")
            for row, end, data, at in texts(batch.column("text")):
                w = words(data, at, lower=False)
                every, starts, first = runs(w, window, short=False)
                n, kept = [], []
                for i in range(end - row):
                    own = slice(first[i], first[i + 1])
                    gone = np.isin(every[own], removed[row + i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    edges = np.zeros(w.counts[i] + 1, dtype=np.int64)
                    at_word = starts[own][gone] - w.first[i]
                    np.add.at(edges, at_word, 1)
                    np.add.at(edges, at_word + window, -1)
                    keep = np.cumsum(edges[:-1]) == 0
                    a, b = w.start[w.first[i] : w.first[i + 1]][keep], w.end[w.first[i] : w.first[i + 1]][keep]
                    n.append(int(len(keep) - keep.sum()))
                    kept.append(b" ".join([data[x:y].tobytes() for x, y in zip(a, b, strict=True)]).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("whole_sha256").slice(row, end - row), pa.array(n, pa.int64()), pa.array(kept, pa.string())],
                    names=["whole_sha256", "n_removed", "kept"],
                )

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """A row for each of documents: doc_id, row_key, n_words, n_removed, whole_sha256 of all its words, kept.

    kept: the words that stay, joined by spaces, or null if all do.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    base = documents.select(row_key().alias("row_key"), "doc_id", "text")
    schema = f"row_key long, doc_id {kind}, text_key long, n_words long, whole_sha256 string, phrases array<long>"
    survey = stored(base.mapInArrow(_survey(window, phrase), schema), "survey")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    firsts = survey.groupBy("whole_sha256").agg(F.min(place).alias("head"))
    firsts = firsts.select("whole_sha256", F.col("head.doc_id").alias("first_id"), F.col("head.row_key").alias("head_key"))
    about = survey.drop("phrases").join(firsts, "whole_sha256")
    heads = survey.join(firsts.select(F.col("head_key").alias("row_key")), "row_key", "left_semi")
    heads = heads.select("row_key", "whole_sha256", "text_key", F.explode("phrases").alias("phrase"))
    shared = heads.groupBy("phrase").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).filter("lo < hi").select("phrase")
    held = stored(heads.join(shared, "phrase").select("row_key", "whole_sha256", "phrase").distinct(), "held")
    owners = held.groupBy("phrase").agg(F.min("row_key").alias("row_key")).groupBy("row_key").agg(F.collect_list("phrase").alias("phrases"))
    spelled = base.select("row_key", "text").join(broadcast_if_small(stored(owners, "owners")), "row_key").select("phrases", "text")
    spelled = stored(spelled.mapInArrow(_spell(window, phrase), "phrase long, codes array<int>").dropDuplicates(["phrase"]), "phrases")
    dealt = held.join(spelled, "phrase").groupBy("row_key").agg(F.first("whole_sha256").alias("whole_sha256"), F.flatten(F.collect_list("codes")).alias("codes"))
    read = stored(base.join(dealt, "row_key").dropDuplicates(["row_key"]), "documents")
    found = read.select("row_key", "doc_id", "text", "codes").mapInArrow(_locate(window, phrase), f"row_key long, doc_id {kind}, h1 long, h2 int")
    first = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    gone = found.withColumn("first", first).filter(later).groupBy("row_key").agg(F.collect_list("h1").alias("removed"))
    cut = read.select("row_key", "whole_sha256", "text").join(gone, "row_key").select("whole_sha256", "text", "removed")
    cut = stored(cut.mapInArrow(_cut(window), "whole_sha256 string, n_removed long, kept string"), "cut")
    earlier = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    copy = earlier & (F.col("n_words") >= window)
    return about.join(cut, "whole_sha256", "left").select(
        "doc_id", "row_key", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        "whole_sha256", F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
