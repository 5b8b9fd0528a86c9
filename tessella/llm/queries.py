"""The queries of the corpus operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import attribution, decontaminate, fingerprints, language, near_dedup, pieces, records, repeats, secrets, toxicity
from tessella.llm.common import held_out, new_path, row_key, table, text_or_empty

BYTE_BPE, BYTE_BPE_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
END_ID = 2


def _sha(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        _sha(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", _sha("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op3_similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.groups(table(spark, sf_dir, "documents"))


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_ID, path)
    return records.offset_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.coalesce(_sha("kept"), "whole_sha256").alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents.filter(~held_out()))
    return language.predict(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, those that cross line ends, and its lines' tokens and ends, joined by commas."""
    counted = attribution.line_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_RANKS), public_tokenizers.PATTERN
    )
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("section_tokens", "section_ends")]
    return counted.select("doc_id", "n_tokens", F.size("section_ends").cast("long").alias("n_sections"), "n_crossing", *joined)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(documents, labels, ~held_out())
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size(toxicity.significant()).cast("long").alias("n_passages"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    spans = secrets.secret_spans(documents)

    def joined(kept: Column) -> Column:
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    none = F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))
    found = documents.select("doc_id", row_key().alias("doc_key")).join(spans, "doc_key", "left").withColumn("spans", none)
    return found.select(
        "doc_id", *[count(kind) for kind in secrets.RULES], _sha(joined(F.filter("spans", lambda s: s["kind"] != "random"))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_sentencepiece, op3_fingerprints, op3_similar_groups, op4_records, op5_repeats, op6_language, op7_near_duplicates,
        op8_token_counts, op9_toxicity, op10_secrets,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT DISTINCT ds.doc_id, ds.i, ds.n, bw.item_id FROM ds JOIN bw ON bw.n = ds.n AND bw.win = array_to_string(ds.w[ds.i:ds.i + ds.n - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
}
