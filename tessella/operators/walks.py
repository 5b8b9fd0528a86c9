"""Random walks. Each step is one join of the walks with the numbered neighbors, keyed by node and neighbor number.

Walks carry the path since the last checkpoint, so that no step's join is made again for the table of all steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.ids import type_of
from tessella.functions.lineage import cut
from tessella.functions.rng import uniform
from tessella.operators.sampling import next_neighbors, rank_neighbors

#: Steps after which a walk's lineage is cut by checkpoint().
STEPS_PER_CHECKPOINT = 5


def random_walks(starts: DataFrame, edges: DataFrame, length: int, seed: int, weighted: bool = False, epochs: int = 1, meta_path: list[int] | None = None) -> DataFrame:
    """start, epoch, step (from 0, the start), node. Walks end early at a node without a next one.

    meta_path: step j goes to a node of type meta_path[j % len(meta_path)]; walks start at nodes of its first type.
    """
    walks = starts.select(F.col("node").alias("start")).distinct()
    if meta_path:
        walks = walks.filter(type_of(F.col("start")) == meta_path[0])
        kinds = {t: _numbered(edges.filter(type_of(F.col("dst")) == t)) for t in set(meta_path)}
    else:
        every = _numbered(edges)
    at = walks.select("start", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), F.array("start").alias("path"), F.col("start").alias("src"), F.lit(True).alias("going"))
    out, first = None, 0
    for step in range(1, length + 1):
        heads, ranked = kinds[meta_path[step % len(meta_path)]] if meta_path else every
        here = at.join(heads, "src", "left").withColumn("deg", F.when(F.col("going"), F.col("deg")))
        moved = next_neighbors(here, ranked, uniform(seed, "start", "epoch", F.lit(step)), weighted, "left")
        path = F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path"))
        # An ended walk goes on under its start, which spreads ended ones over tasks.
        at = moved.select("start", "epoch", path.alias("path"), F.coalesce("dst", "start").alias("src"), F.col("dst").isNotNull().alias("going"))
        if step % STEPS_PER_CHECKPOINT == 0 and step < length:
            at = cut(at)
            out, first = _steps(at, first, out), step
            at = at.filter("going").withColumn("path", F.array("src"))
    return _steps(at, first, out)


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """src, deg; and the numbered neighbors"""
    return edges.groupBy("src").agg(F.count("*").alias("deg")), rank_neighbors(edges)


def _steps(at: DataFrame, first: int, before: DataFrame | None) -> DataFrame:
    """before, and start, epoch, step, node from paths whose first node is of step first, which before has"""
    rows = at.select("start", "epoch", F.posexplode("path").alias("step", "node"))
    rows = rows.select("start", "epoch", (F.col("step") + first).alias("step"), "node")
    return rows if before is None else before.union(rows.filter(F.col("step") > first))


def sequences(walks: DataFrame) -> DataFrame:
    """start, epoch, nodes with the start first; walks without a step are left out"""
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("step", "node"))), lambda x: x["node"])
    return walks.groupBy("start", "epoch").agg(nodes.alias("nodes")).filter(F.size("nodes") > 1)


def walk_edges(walks: DataFrame) -> DataFrame:
    """src, dst: an edge from the start to each later node"""
    return walks.filter("step > 0").select(F.col("start").alias("src"), F.col("node").alias("dst"))
