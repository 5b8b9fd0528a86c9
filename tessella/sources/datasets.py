"""Public graph data made into edge, feature and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.rng import uniform
from tessella.operators.graph import symmetrize

#: Fixed value: keeps rows of zeros from a division by nought.
TINY = 1e-7


def normalize_rows(features: DataFrame) -> DataFrame:
    """node, fid, v: each value over its node's sum; zeros go"""
    total = F.sum("v").over(Window.partitionBy("node")) + TINY
    return features.select("node", "fid", (F.col("v") / total).alias("v")).filter("v <> 0")


def standardize(features: DataFrame, train: DataFrame) -> DataFrame:
    """node, fid, v with mean 0 and deviation 1 over the training nodes; zeros go.

    features have a row for each node and feature, zeros too. A feature that is constant in training is only moved; one that
    training lacks stays.
    """
    seen = features.join(train.select("node").distinct(), "node", "left_semi")
    stats = seen.groupBy("fid").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    scaled = (F.col("v") - F.coalesce("mean", F.lit(0.0))) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return features.join(stats, "fid", "left").select("node", "fid", scaled.alias("v")).filter("v <> 0")


def train_split(nodes: DataFrame, ratio: float, seed: int) -> DataFrame:
    """node, stage: train with probability ratio, else test"""
    return nodes.select("node", F.when(uniform(seed, "node") < ratio, "train").otherwise("test").alias("stage"))


def undirected(links: DataFrame) -> DataFrame:
    """src, dst, w: each link (src, dst) once in both directions, with weight 1"""
    return symmetrize(links.select("src", "dst", F.lit(1.0).alias("w")))


def _numbers(spark: SparkSession, names: DataFrame, name: str) -> DataFrame:
    """The distinct names, numbered from 0 in their order. Ranges of a sorted table are counted, then numbered each by itself."""
    sorted_names = names.select(F.col("name")).distinct().orderBy("name").withColumn("_p", F.spark_partition_id())
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sorted_names.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_b", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("name")) - 1
    return sorted_names.withColumn("_r", own).join(F.broadcast(sizes), "_p").select("name", (F.col("_r") + F.col("_b")).cast("long").alias(name))


def read_citations(spark: SparkSession, content: str, cites: str) -> dict[str, DataFrame]:
    """edges, features, labels from papers (name, 0/1 words, class, by tabs) and citations (two names).

    Papers and classes are numbered in the order of their names; citations of unknown papers go.
    """
    cells = spark.read.text(content).select(F.split("value", "\t").alias("c")).filter(F.size("c") > 2)
    papers = cells.select(F.col("c")[0].alias("name"), F.slice("c", 2, F.size("c") - 2).cast("array<double>").alias("x"), F.element_at("c", -1).alias("kind"))
    ids, kinds = _numbers(spark, papers, "node"), _numbers(spark, papers.select(F.col("kind").alias("name")), "label")
    known = papers.join(ids, "name")
    words = known.select("node", F.posexplode("x").alias("fid", "v")).select("node", F.col("fid").cast("long").alias("fid"), "v")
    labels = known.join(F.broadcast(kinds.withColumnRenamed("name", "kind")), "kind").select("node", F.array(F.col("label").cast("int")).alias("labels"))
    pair = spark.read.text(cites).select(F.split("value", "\t").alias("c")).filter(F.size("c") == 2).select(F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))
    links = pair.join(ids.toDF("a", "src"), "a").join(ids.toDF("b", "dst"), "b")
    return {"edges": undirected(links), "features": normalize_rows(words), "labels": labels}
