"""Skip-gram embeddings with negative sampling, trained by synchronous steps over partitions of the pairs.

Parameters are tables (id, vec). A step joins each pair with its two vectors, sums the gradients of each id before the
shuffle, and adds them; so neither the driver nor a task holds the table. Steps are full passes with a decaying rate, where
an id's gradient is the mean over its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.lineage import cut
from tessella.functions.rng import uniform
from tessella.functions.vectors import dot


def initial(nodes: DataFrame, dim: int, seed: int, zero: bool = False) -> DataFrame:
    """id, vec: uniform within 1 / (2 dim), or zeros"""
    cell = (lambda k: F.lit(0.0)) if zero else (lambda k: (uniform(seed, "node", F.lit(k)) - 0.5) / dim)
    return nodes.select(F.col("node").alias("id"), F.array(*[cell(k) for k in range(dim)]).alias("vec"))


def step(pairs: DataFrame, w_in: DataFrame, w_out: DataFrame, dim: int, rate: float) -> tuple[DataFrame, DataFrame]:
    """Both tables after one pass over pairs (src, dst, y)"""
    found = pairs.join(w_in.toDF("src", "a"), "src").join(w_out.toDF("dst", "b"), "dst")
    g = F.col("y") - 1 / (1 + F.exp(-dot(F.col("a"), F.col("b"))))
    found = found.select("src", "dst", "a", "b", g.alias("g"))

    def moved(table: DataFrame, key: str, other: str) -> DataFrame:
        mean = found.groupBy(F.col(key).alias("id")).agg(F.array(*[F.avg(F.col("g") * F.col(other)[k]) for k in range(dim)]).alias("d"))
        return table.join(mean, "id", "left").select("id", F.when(F.col("d").isNull(), F.col("vec")).otherwise(
            F.zip_with("vec", "d", lambda v, d: v + rate * d)).alias("vec"))

    return moved(w_in, "src", "b"), moved(w_out, "dst", "a")


def loss(pairs: DataFrame, w_in: DataFrame, w_out: DataFrame) -> float:
    """The mean cross-entropy"""
    z = dot(F.col("a"), F.col("b"))
    signed = F.when(F.col("y") == 1, z).otherwise(-z)
    found = pairs.join(w_in.toDF("src", "a"), "src").join(w_out.toDF("dst", "b"), "dst")
    return found.agg(F.avg(F.greatest(-signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed))))).first()[0]


def train(pairs: DataFrame, nodes: DataFrame, dim: int = 16, steps: int = 5, rate: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Input and output tables. Each step is checkpointed, which cuts the lineage and survives lost executors."""
    w_in, w_out = initial(nodes, dim, seed), initial(nodes, dim, seed + 1)
    for k in range(steps):
        w_in, w_out = (cut(w) for w in step(pairs, w_in, w_out, dim, rate / (1 + 0.1 * k)))
    return w_in, w_out


def predict(pairs: DataFrame, w_in: DataFrame, w_out: DataFrame) -> DataFrame:
    """pairs with the probability of label 1"""
    found = pairs.join(w_in.toDF("src", "a"), "src").join(w_out.toDF("dst", "b"), "dst")
    return found.withColumn("p", 1 / (1 + F.exp(-dot(F.col("a"), F.col("b"))))).drop("a", "b")
