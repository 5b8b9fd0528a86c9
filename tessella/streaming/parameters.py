"""Parameter tables (id, vec, ts) that grow by batches: upserts, expiry, admission by frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.tensors import upsert


def expire(params: DataFrame, now: int, ttl: int) -> DataFrame:
    return params.filter(F.col("ts") >= now - ttl)


def admit(counts: DataFrame, least: int) -> DataFrame:
    """The ids that came up at least so many times, of (id, n)"""
    return counts.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def newest(updates: DataFrame) -> DataFrame:
    """The latest of several updates of an id; of equal times the largest vector"""
    order = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("vec"))
    return updates.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def warm_start(params: DataFrame, other: DataFrame) -> DataFrame:
    """other's parameters where params has none"""
    return upsert(other, params)


class ParameterTable:
    """Versions of a table under path. A batch that comes again after a failure writes its own version again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self, batch: int) -> str:
        return f"{self.path}/v={batch:010d}"

    def read(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(self.version(batch))

    def apply(self, updates: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        fresh = newest(updates.select("id", "vec", "ts"))
        out = upsert(self.read(batch - 1), fresh) if batch else fresh
        out.write.mode("overwrite").parquet(self.version(batch))


def stream_counts(ids: DataFrame) -> DataFrame:
    """Running counts of a stream of ids, for admit"""
    return ids.groupBy("id").agg(F.count("*").alias("n"))
