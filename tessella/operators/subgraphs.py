"""Sampled subgraphs by levels, their blocks of indexes, and random masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.lineage import cut
from tessella.functions.rng import uniform
from tessella.operators.graph import dense_index
from tessella.operators.sampling import sample_neighbors


def sample_levels(seeds: DataFrame, edges: DataFrame, fanouts: list[int], seed: int) -> tuple[DataFrame, DataFrame]:
    """(level, node): level 0 has the distinct seeds, each next one the distinct samples of the last; and (level, node, nbr)

    Each level is drawn once, as all later ones and the blocks read it again.
    """
    at = cut(seeds.select("node").distinct())
    levels, links = at.select(F.lit(0).alias("level"), "node"), None
    for k, fanout in enumerate(fanouts):
        picked = cut(sample_neighbors(at, edges, fanout, seed + k).select(F.lit(k).alias("level"), "node", "nbr").distinct())
        links = picked if links is None else links.union(picked)
        at = picked.select(F.col("nbr").alias("node")).distinct()
        levels = levels.union(at.select(F.lit(k + 1).alias("level"), "node"))
    return levels, links


def level_index(levels: DataFrame) -> DataFrame:
    """level, node, idx: numbers that run on over the levels, by id within each"""
    sizes = [r.n for r in levels.groupBy("level").agg(F.count("*").alias("n")).orderBy("level").collect()]  # a row a level
    out, before = None, 0
    for level, n in enumerate(sizes):
        own = dense_index(levels.filter(F.col("level") == level)).select(F.lit(level).alias("level"), "node", (F.col("idx") + before).alias("idx"))
        out, before = own if out is None else out.union(own), before + n
    return out


def blocks(levels: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """block, kind (self or neigh), row, col. Block i has a row for each node of levels 0 to depth - 1 - i, in order."""
    index = level_index(levels)
    nbr = index.select((F.col("level") - 1).alias("level"), F.col("node").alias("nbr"), F.col("idx").alias("col"))
    own = index.select("level", "node", F.col("idx").alias("row"))
    neigh = links.join(own, ["level", "node"]).join(nbr, ["level", "nbr"]).select("level", F.lit("neigh").alias("kind"), "row", "col")
    self_ = own.filter(F.col("level") < depth).select("level", F.lit("self").alias("kind"), "row", F.col("row").alias("col"))
    every = self_.union(neigh)
    in_blocks = every.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(depth - 1) - F.col("level"))))
    return in_blocks.select("block", "kind", "row", "col")


def drop_edges(links: DataFrame, p: float, seed: int) -> DataFrame:
    """Each (node, nbr) stays with probability 1 - p"""
    return links.filter(uniform(seed, "node", "nbr") >= p)


def mask_features(features: DataFrame, p: float, seed: int) -> DataFrame:
    """Each (node, fid) stays with probability 1 - p"""
    return features.filter(uniform(seed, "node", "fid") >= p)


def shuffle(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.orderBy(uniform(seed, key), key)
