"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index stores, for each word of a document that any benchmark window uses, its term, document and position. A search
takes for each window the postings of its rarest term, shifts them by the term's offset in the window to the starts they
imply, and intersects these with the shifted postings of the next terms, rarest first. slop=0 finds exact phrases; with
slop > 0 each term may stand up to that many words from its place (proximity).

Defined results: null or wordless texts have no words and match nothing; items with a null id are ignored; rows that
repeat doc_id and text each get the same result; items that repeat an id have all their windows under that id; other
columns of the inputs are not read. Windows of an item with fewer words than asked for are the whole item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, broadcast_if_small, free_name, row_key, stored, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Offsets of a window are kept as bits of a long.
LONGEST_WINDOW = 63


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def query_windows(benchmark: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(win_id, off, term_id, term, n) of all windows of the items, and (win_id, item_id)."""
    if not 0 < size <= LONGEST_WINDOW:
        raise ValueError(f"a window has 1 to {LONGEST_WINDOW} words")
    items = benchmark.filter("item_id is not null").select("item_id", words(text_or_empty()).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    wins = items.filter(F.size("w") > 0).select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("win")
    )
    wins = stored(wins.select(F.xxhash64("win").alias("win_id"), "item_id", "win").distinct(), "windows")
    terms = (
        wins.select("win_id", "win").distinct()
        .select("win_id", F.size("win").alias("n"), F.posexplode("win").alias("off", "term"))
        .withColumn("term_id", F.xxhash64("term"))
    )
    return terms, wins.select("win_id", "item_id").distinct()


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Store the postings (term_id, doc_key, pos) of the terms in all documents.

    A document's first row also stands for the document itself (doc_id, n_words), with a null term if its first word is
    no term, and a null pos if it has no words.
    """
    vocabulary = broadcast_if_small(stored(terms.select("term", "term_id").distinct(), "vocabulary"))
    tokens = documents.select("doc_id", row_key().alias("doc_key"), words(text_or_empty()).alias("w"))
    postings = tokens.select(
        "doc_id", "doc_key", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "term")
    ).join(vocabulary, "term", "left")
    kept = F.col("term_id").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0)
    return stored(postings.filter(kept).select("term_id", "doc_key", "pos", "doc_id", "n_words"), "postings")


def search(index: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """All occurrences (win_id, doc_key, start, n) of the windows, where start is the place that the rarest term implies."""
    postings = index.filter("term_id is not null").select("term_id", "doc_key", "pos")
    counts = postings.groupBy("term_id").agg(F.count("*").alias("freq"))
    known = terms.join(counts, "term_id").select("win_id", "off", "term_id", "n", "freq")
    window = Window.partitionBy("win_id")
    ranked = stored(
        known.withColumn("found", F.count("*").over(window))
        .filter("found = n")  # a window with a term that no document has cannot occur
        .withColumn("rarity", F.row_number().over(window.orderBy("freq", "off")))
        .select("win_id", "off", "term_id", "n", "rarity"),
        "ranked",
    )
    first = broadcast_if_small(ranked.filter("rarity = 1").select("win_id", "off", "term_id"))
    found = postings.join(first, "term_id").select("win_id", "doc_key", (F.col("pos") - F.col("off")).alias("start"))
    found = stored(found.filter(F.col("start") >= -slop).distinct(), "starts")
    for step in (2, LONGEST_WINDOW):
        found = stored(_intersect(found, ranked.filter(F.col("rarity") <= step), postings, slop), "starts")
    return found.join(broadcast_if_small(terms.select("win_id", "n").distinct()), "win_id")


def _intersect(found: DataFrame, terms: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """Those starts at which every one of the window's terms has a posting at its offset."""
    need = terms.groupBy("win_id").agg(F.count("*").alias("need"))
    wanted = found.join(broadcast_if_small(terms.join(need, "win_id")), "win_id").withColumn(
        "pos", F.explode(F.sequence(F.col("start") + F.col("off") - slop, F.col("start") + F.col("off") + slop))
    )
    there = postings.join(broadcast_if_small(terms.select("term_id").distinct()), "term_id", "left_semi").join(
        broadcast_if_small(found.select("doc_key").distinct()), "doc_key", "left_semi"
    )
    offsets = F.bit_count(F.bit_or(F.expr("shiftleft(1L, off)")))
    return (
        wanted.join(there, ["doc_key", "pos", "term_id"])
        .groupBy("win_id", "doc_key", "start")
        .agg(offsets.alias("got"), F.first("need").alias("need"))
        .filter("got = need")
        .select("win_id", "doc_key", "start")
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row for each of documents: doc_id, doc_key, n_words, n_hit (words in occurring windows), items (sorted ids)."""
    terms, win_items = query_windows(benchmark, size)
    index = build_index(documents, terms)
    found = stored(search(index, terms), "matches")
    spans = found.select("doc_key", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("doc_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = (
        spans.withColumn("fresh", F.greatest(F.col("end") - fresh, F.lit(0)))
        .groupBy("doc_key").agg(F.sum("fresh").alias("n_hit"))
    )
    items = (
        found.join(broadcast_if_small(win_items), "win_id")
        .groupBy("doc_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    heads = index.filter("pos is null or pos = 0").select("doc_id", "doc_key", F.col("n_words").cast("long"))
    return (
        heads.join(hits, "doc_key", "left").join(items, "doc_key", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    own = free_name("_hit", documents)
    hit = contamination(documents, benchmark, size).filter("n_hit > 0").select(F.col("doc_key").alias(own)).distinct()
    return documents.join(broadcast_if_small(stored(hit, "hit")), row_key() == F.col(own), "left_anti")
