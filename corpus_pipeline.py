"""A corpus of documents made ready for training: known languages, no near copies, no benchmark text, no secrets, tokens.

Defined results: a document without a text, or without a letter in it, goes in the first stage. A null doc_id is a document
like others, that is no copy of any. Of rows that repeat a doc_id, the second stage keeps one, or none if the id has a copy
with a smaller one. An empty table gives an empty one, an empty benchmark rejects nothing. Further columns stay up to the last
stage, which gives doc_id, ids and decoded alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, language, near_dedup, pieces, secrets
from tessella.llm.common import settled, table
from tessella.llm.queries import PIECES


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents; those go that have no letter, or that the decoder puts far from all it learned."""
    return language.keep_known(docs, language.train_with_limits(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, by five-word shingles at a similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten words of a benchmark item in a row occur, or a whole shorter item, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with the end id, and the text that they decode to."""
    return pieces.round_trip(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("language", known_language),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("sentencepiece", tokens),
]

#: The stages learn, hash and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023
    return docs
