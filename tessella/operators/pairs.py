"""Training pairs from sequences and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ids import type_of
from tessella.functions.rng import uniform
from tessella.operators.graph import dense_index
from tessella.operators.sampling import independent_negatives, negatives, redraw


def context_pairs(seqs: DataFrame, key: str, nodes: str, left: int, right: int) -> DataFrame:
    """key, i, j, center, context: all j != i within the window, from whole arrays in place, with no shuffle"""
    n = F.size(nodes)
    centers = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.get(F.col(nodes), i).alias("center")))
    rows = seqs.filter(n > 0).select(key, nodes, F.inline(centers))
    around = F.sequence(F.greatest(F.col("i") - left, F.lit(0)), F.least(F.col("i") + right, F.size(nodes) - 1))
    pairs = rows.select(key, nodes, "i", "center", F.explode(F.filter(around, lambda j: j != F.col("i"))).alias("j"))
    return pairs.select(key, "i", "j", "center", F.get(F.col(nodes), F.col("j")).alias("context"))


def cross_type_pairs(seqs: DataFrame, key: str, nodes: str, window: int, user: int) -> DataFrame:
    """key, src, dst: pairs of nodes of different types within the window; src is the user"""
    pairs = context_pairs(seqs, key, nodes, window, window)
    pairs = pairs.filter(type_of(F.col("center")) != type_of(F.col("context")))
    first = type_of(F.col("center")) == user
    return pairs.select(
        key, F.when(first, F.col("center")).otherwise(F.col("context")).alias("src"), F.when(first, F.col("context")).otherwise(F.col("center")).alias("dst")
    )


def pairs_with_negatives(pairs: DataFrame, dist: DataFrame, count: int, seed: int) -> DataFrame:
    """src, dst, y from (key, i, center, context): y is 1 for pairs, and 0 for the negatives of a position, which each of its pairs gets.

    Negatives are of the center's type, and none is in the position's sequence (key), as far as that is among pairs.
    """
    positive = pairs.select(F.col("center").alias("src"), F.col("context").alias("dst"), F.lit(1).alias("y"))
    spots = pairs.select("key", "i", type_of(F.col("center")).alias("ns")).distinct()
    spots = spots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    own = pairs.select("key", F.col("center").alias("drawn")).union(pairs.select("key", "context"))
    drawn = redraw(spots, dist, own, ["key"], lambda k: uniform(seed, "key", "i", "draw", F.lit(k)))
    negative = pairs.select("key", "i", "center").join(drawn, ["key", "i"]).select(F.col("center").alias("src"), F.col("drawn").alias("dst"), F.lit(0).alias("y"))
    return positive.union(negative)


def edges_with_negatives(edges: DataFrame, dist: DataFrame, count: int, seed: int) -> DataFrame:
    """src, dst, y: an edge has y 1; count negatives of each source, of dst's type and none of them among its edges, have y 0"""
    spots = edges.select("src", type_of(F.col("dst")).alias("ns")).distinct()
    spots = spots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    own = edges.select("src", F.col("dst").alias("drawn"))
    drawn = redraw(spots, dist, own, ["src"], lambda k: uniform(seed, "src", "draw", F.lit(k)))
    return edges.select("src", "dst", F.lit(1).alias("y")).union(drawn.select("src", F.col("drawn").alias("dst"), F.lit(0).alias("y")))


def softmax_columns(samples: DataFrame, dist: DataFrame, count: int, seed: int) -> DataFrame:
    """row, col, item from (row, item): column 0 is the positive, which is class 0; the others are negatives that its namespace shares"""
    positive = samples.select("row", F.lit(0).alias("col"), "item")
    spaces = samples.select(type_of(F.col("item")).alias("ns")).distinct()
    drawn = negatives(spaces, dist, samples.select(F.lit(0).alias("ns"), F.lit(None).cast("long").alias("node")).limit(0), count, seed, [])
    spread = samples.select("row", type_of(F.col("item")).alias("ns")).join(F.broadcast(drawn), "ns")
    return positive.union(spread.select("row", (F.col("draw") + 1).alias("col"), F.col("drawn").alias("item")))


def with_items(samples: DataFrame, items: DataFrame) -> DataFrame:
    """row, item: each row with each of its namespace's shared items (ns, drawn), which are as many as were drawn"""
    return samples.select("row", type_of(F.col("item")).alias("ns")).join(F.broadcast(items), "ns").select("row", F.col("drawn").alias("item"))


def label_matrix(labels: DataFrame, num_label: int, max_label: int) -> DataFrame:
    """node, position, label; a wrong count or a label beyond max_label raises when read"""
    wrong = (F.size("labels") != num_label) | F.exists("labels", lambda x: x > max_label)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("labels of "), F.col("node")))).otherwise(F.col("labels"))
    return labels.select("node", F.posexplode(checked.cast("array<int>")).alias("position", "label"))


def with_self(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, fid, v with each node's own id as a feature of value 1"""
    return features.select("node", "fid", "v").union(nodes.select("node", F.col("node").alias("fid"), F.lit(1.0).alias("v")))


def batches(nodes: DataFrame, size: int) -> DataFrame:
    """node, batch: so many distinct nodes a batch, by unsigned id"""
    return dense_index(nodes).select("node", F.floor(F.col("idx") / size).alias("batch"))


def one_sequence(rows: DataFrame, nodes: str = "nodes") -> DataFrame:
    """rows, raising when read where the sequence has fewer than two nodes"""
    wrong = F.raise_error(F.concat(F.lit("a sequence of "), F.size(nodes), F.lit(" nodes")))
    return rows.withColumn(nodes, F.when(F.size(nodes) > 1, F.col(nodes)).otherwise(wrong))


def sort_pairs(pairs: Column) -> Column:
    """An array of pairs by type, then by ascending weight; those that are equal in both stay in order"""
    placed = F.transform(pairs, lambda x, i: F.struct(type_of(x["id"]).alias("t"), x["w"].alias("w"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def members(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (node, ...) whose node is among nodes"""
    return rows.join(nodes.select("node").distinct(), "node", "left_semi")


def bounded_features(features: DataFrame, most: float) -> DataFrame:
    """The features (..., v) with a value of at most that size; nulls go"""
    return features.filter(F.abs("v") <= most)


def only_one(pairs: Column, kind: int) -> Column:
    """The one id of that type in an array of pairs; none or several raise when read"""
    own = F.filter(pairs, lambda x: type_of(x["id"]) == kind)
    return F.when(F.size(own) == 1, own[0]["id"]).otherwise(F.raise_error(F.lit(f"not one id of type {kind}")))


def global_shuffle(nodes: DataFrame, dist: DataFrame, seed: int) -> DataFrame:
    """node, drawn: a random node of its namespace for each"""
    none = nodes.select(F.lit(0).alias("ns"), F.lit(None).cast("long").alias("node")).limit(0)
    return independent_negatives(nodes, dist, none, 1, seed).select("node", "drawn")
