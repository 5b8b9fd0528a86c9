"""Lookups of node tables by keys. Keys keep their duplicates; a missing key has the default stated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import vector_sum


def lookup_context(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """node, dst, w: nothing for a missing node"""
    return keys.join(edges.withColumnRenamed("src", "node"), "node")


def lookup_features(keys: DataFrame, features: DataFrame) -> DataFrame:
    """node, fid, v: the one feature (0, 0) for a missing node"""
    found = keys.join(features, "node", "left")
    return found.select(*keys.columns, F.coalesce("fid", F.lit(0)).alias("fid"), F.coalesce("v", F.lit(0.0)).alias("v"))


def lookup_items(keys: DataFrame, features: DataFrame) -> DataFrame:
    """node, fid, v: a missing item raises when read"""
    found = keys.join(features, "node", "left")
    missing = F.raise_error(F.concat(F.lit("no features of item "), F.col("node")))
    return found.select(*keys.columns, F.when(F.col("fid").isNull(), missing).otherwise(F.col("fid")).cast("long").alias("fid"), "v")


def lookup_degrees(keys: DataFrame, degrees: DataFrame) -> DataFrame:
    found = keys.join(degrees, "node", "left")
    return found.select(*keys.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")])


def lookup_index(keys: DataFrame, index: DataFrame) -> DataFrame:
    """node, idx: -1 for a missing node"""
    return keys.join(index.select("node", "idx"), "node", "left").select(*keys.columns, F.coalesce("idx", F.lit(-1)).alias("idx"))


def embedding_lookup(pairs: DataFrame, weights: DataFrame, dim: int) -> DataFrame:
    """row, vec: the sum of v times the vector of fid over pairs (row, fid, v); missing vectors are zero"""
    found = pairs.join(weights.select(F.col("id").alias("fid"), "vec"), "fid", "left")
    sums = found.groupBy("row").agg(vector_sum("vec", dim, F.col("v")).alias("vec"))
    return sums.select("row", F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0))).alias("vec"))


def group_embedding_lookup(pairs: DataFrame, weights: DataFrame, groups: list[int], dim: int) -> DataFrame:
    """row, vec: the groups' sums side by side; a group without features is zeros"""
    from tessella.functions.ids import type_of

    found = pairs.withColumn("g", type_of(F.col("fid"))).join(weights.select(F.col("id").alias("fid"), "vec"), "fid", "left")
    cells = [F.coalesce(F.sum(F.when(F.col("g") == g, F.col("v") * F.col("vec")[k])), F.lit(0.0)) for g in groups for k in range(dim)]
    return found.groupBy("row").agg(F.array(*cells).alias("vec"))
