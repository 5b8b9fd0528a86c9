"""Sparse matrices as rows (row, col, x), dense ones as (id, vec)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import dot, scale, softmax, vector_sum


def sum_aggregate(x: DataFrame, w: DataFrame, dim: int) -> DataFrame:
    """row, vec: the sum of x times the vector of col"""
    return x.join(w.withColumnRenamed("id", "col"), "col").groupBy("row").agg(vector_sum("vec", dim, F.col("x")).alias("vec"))


def mean_aggregate(x: DataFrame, w: DataFrame, dim: int) -> DataFrame:
    """row, vec: the same over the sum of x"""
    found = x.join(w.withColumnRenamed("id", "col"), "col").groupBy("row").agg(vector_sum("vec", dim, F.col("x")).alias("vec"), F.sum("x").alias("s"))
    return found.select("row", scale(F.col("vec"), 1 / F.col("s")).alias("vec"))


def hidden_lookup(x: DataFrame, w: DataFrame, rows: int, dim: int) -> DataFrame:
    """row, vec: columns are taken modulo the number of rows of w"""
    return sum_aggregate(x.withColumn("col", F.pmod("col", F.lit(rows))), w, dim)


def edge_softmax(edges: DataFrame, row: str = "row", logit: str = "x") -> DataFrame:
    """edges with p, the softmax of the logits of a row"""
    by_row = Window.partitionBy(row)
    e = F.exp(F.col(logit) - F.max(logit).over(by_row))
    return edges.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(by_row)).drop("_e")


def batch_dot(pairs: DataFrame, w_in: DataFrame, w_out: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with z, the inner product of their vectors"""
    found = pairs.join(w_in.toDF("a", "_va"), "a").join(w_out.toDF("b", "_vb"), "b")
    return found.withColumn("z", dot(F.col("_va"), F.col("_vb"))).drop("_va", "_vb")


def weighted_average(rows: DataFrame, k: int, dim: int) -> DataFrame:
    """row, vec: k vectors side by side in vec, averaged by the softmax of weights"""
    p = softmax(F.col("weights"))
    cells = [F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda g: F.get(p, g) * F.get(F.col("vec"), g * dim + d)), F.lit(0.0), lambda t, v: t + v) for d in range(dim)]  # noqa: B023
    return rows.select("row", F.array(*cells).alias("vec"))


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table with rows in place of those with their keys"""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)
