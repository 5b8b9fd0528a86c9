"""Graphs as edge tables (src, dst, w), and statistics of them. Edges are directed as stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import shard_of, type_of, unsigned_order


def explode_pairs(adj: DataFrame, key: str = "src", other: str = "dst") -> DataFrame:
    return adj.select(F.col("node").alias(key), F.inline("pairs").alias(other, "w"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, pairs sorted by unsigned id. One row for each source, which holds its whole list."""
    pairs = F.sort_array(F.collect_list(F.struct(unsigned_order(F.col("dst")).alias("o"), F.col("dst").alias("id"), F.col("w").cast("float").alias("w"))))
    return edges.groupBy(F.col("src").alias("node")).agg(F.transform(pairs, lambda x: F.struct(x["id"].alias("id"), x["w"].alias("w"))).alias("pairs"))


def check_unique(adj: DataFrame) -> DataFrame:
    """adj, raising when read if a node repeats."""
    again = F.count("*").over(Window.partitionBy("node")) > 1
    return adj.withColumn("node", F.when(again, F.raise_error(F.concat(F.lit("repeated node "), F.col("node")))).otherwise(F.col("node")))


def symmetrize(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").union(edges.select("dst", "src", "w")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree of all nodes that edges name"""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def node_frequency(edges: DataFrame) -> DataFrame:
    """node, freq: 1 for a source, and 1 for each time it is a neighbor"""
    both = edges.select(F.col("dst").alias("node")).union(edges.select("src").distinct())
    return both.groupBy("node").agg(F.count("*").alias("freq"))


def namespace_totals(freq: DataFrame) -> DataFrame:
    return freq.groupBy(type_of(F.col("node")).alias("ns")).agg(F.count("*").alias("nodes"), F.sum("freq").alias("freq"))


def shard_distribution(freq: DataFrame, shards: int) -> DataFrame:
    """ns, shard, freq, prob: each shard's share of a namespace's frequency"""
    cells = freq.groupBy(type_of(F.col("node")).alias("ns"), shard_of(F.col("node"), shards).alias("shard")).agg(F.sum("freq").alias("freq"))
    return cells.withColumn("prob", F.col("freq") / F.sum("freq").over(Window.partitionBy("ns")))


def dense_index(nodes: DataFrame) -> DataFrame:
    """node, idx: from 0, by unsigned id. Counts by ranges of ids first, so no task sees all nodes."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.select("node").distinct().withColumn("_o", unsigned_order(F.col("node")))
    cuts = sorted(set(nodes.stat.approxQuantile("_o", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < F.col("_o").cast("double")))
    nodes = nodes.withColumn("_p", part)
    totals = nodes.groupBy("_p").agg(F.count("*").alias("_n"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1
    return nodes.withColumn("_r", within).join(F.broadcast(before), "_p").select("node", (F.col("_r") + F.col("_b")).cast("long").alias("idx"))


def namespace_index(nodes: DataFrame) -> DataFrame:
    """node, ns, idx within its namespace, global_idx: idx after all nodes of smaller namespaces"""
    dense = dense_index(nodes).withColumn("ns", type_of(F.col("node")))
    first = dense.groupBy("ns").agg(F.min("idx").alias("first"))
    return dense.join(F.broadcast(first), "ns").select("node", "ns", (F.col("idx") - F.col("first")).alias("idx"), F.col("idx").alias("global_idx"))


def neighbor_probability(edges: DataFrame) -> DataFrame:
    """src, dst, prob: w over the sum of the source's weights; a weight of nought or less raises when read"""
    prob = F.col("w") / F.sum("w").over(Window.partitionBy("src"))
    return edges.select("src", "dst", F.when(F.col("w") <= 0, F.raise_error(F.concat(F.lit("weight of an edge from "), F.col("src")))).otherwise(prob).alias("prob"))
