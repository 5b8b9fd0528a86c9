"""Negative and neighbor sampling. Draws are keyed by what they are for, so they repeat for a seed."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import type_of
from tessella.functions.lineage import cut
from tessella.functions.rng import uniform

#: Fixed values of the distributions: the exponent of frequencies, and table slots for each node.
POWER, SLOTS = 0.75, 10
#: Draws for a negative that is no positive, at most.
ROUNDS = 100
UNIFORM, ALIAS, WORD2VEC, PARTIAL_SUM = range(4)


def negative_distribution(freq: DataFrame, kind: int = PARTIAL_SUM) -> DataFrame:
    """ns, node, prob. kind: uniform; alias and partial sum, freq**0.75; the word2vec table, that to the power again, in slots"""
    nodes = freq.select(type_of(F.col("node")).alias("ns"), "node", F.col("freq").cast("double").alias("freq"))
    weight = F.lit(1.0) if kind == UNIFORM else F.pow("freq", F.lit(POWER))
    weighted = _shares(nodes.select("ns", "node", weight.alias("prob")))
    return word2vec_table(weighted) if kind == WORD2VEC else weighted


def _shares(weighted: DataFrame) -> DataFrame:
    """ns, node, prob: each weight (prob) over its namespace's sum. Sums are taken before the shuffle; there is a row for each of the types, 65,536 at most."""
    totals = weighted.groupBy("ns").agg(F.sum("prob").alias("_total"))
    return weighted.join(F.broadcast(totals), "ns").select("ns", "node", (F.col("prob") / F.col("_total")).alias("prob"))


def prefix_sums(table: DataFrame, by: str, order: list[Column], value: str) -> DataFrame:
    """table with upto: the sum of value up to each row, in that order within by.

    Rows are sorted by ranges over all tasks; a range's own sums and the sums of the ranges before it, one row for each range,
    give the result, so no task sees all rows of a value of by.
    """
    spark = table.sparkSession
    ranges = table.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(by), *order)
    ranges = cut(ranges.withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy(by, "_range").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(by, "_range", F.coalesce(before, F.lit(0.0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("_own", own).join(F.broadcast(sums), [by, "_range"]).withColumn("upto", F.col("_own") + F.col("_before")).drop("_own", "_range", "_before")


def word2vec_table(weighted: DataFrame) -> DataFrame:
    """The distribution of a table of ten slots for each node, which nodes fill by descending prob**0.75"""
    by_ns = Window.partitionBy("ns")
    p = weighted.select("ns", "node", F.pow("prob", F.lit(POWER)).alias("p"), F.count("*").over(by_ns).alias("n"))
    share = F.sum("p").over(by_ns.orderBy(F.desc("p"), "node").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("p").over(by_ns)
    ends = p.withColumn("end", F.least(F.ceil(share * F.col("n") * SLOTS - 1e-9), F.col("n") * SLOTS))
    start = F.coalesce(F.lag("end").over(by_ns.orderBy(F.desc("p"), "node")), F.lit(0))
    return ends.select("ns", "node", ((F.col("end") - start) / (F.col("n") * SLOTS)).alias("prob"))


def cumulative(dist: DataFrame) -> DataFrame:
    """ns, node, lo, hi: a draw u in (lo, hi] takes the node"""
    return prefix_sums(dist, "ns", [F.col("node")], "prob").select("ns", "node", (F.col("upto") - F.col("prob")).alias("lo"), F.col("upto").alias("hi"))


def _cells(table: DataFrame, key: list[str]) -> DataFrame:
    """table (key, lo, hi, n) once for each of the n equal cells of [0, 1] that it overlaps: at most two for each row on average"""
    first, last = F.floor(F.greatest("lo", F.lit(0.0)) * F.col("n")), F.floor(F.least("hi", F.lit(1.0)) * F.col("n"))
    return table.withColumn("cell", F.explode(F.sequence(first, F.least(last, F.col("n") - 1 + F.lit(0).cast("long")))))


def draw(requests: DataFrame, dist: DataFrame, u: Column) -> DataFrame:
    """requests (ns, ...) with the node that u in [0, 1) draws from its namespace. An equi-join by cells: no task sees a whole namespace's table for each draw."""
    table = cumulative(dist)
    sizes = table.groupBy("ns").agg(F.count("*").alias("n"), F.max("node").alias("_top"))  # a row for each type
    table = table.join(F.broadcast(sizes), "ns").withColumn("hi", F.when(F.col("node") == F.col("_top"), 1.0).otherwise(F.col("hi"))).drop("_top")
    sizes = sizes.drop("_top")
    asked = requests.join(F.broadcast(sizes), "ns").withColumn("u", u).withColumn("cell", F.floor(F.col("u") * F.col("n")))
    cells = _cells(table, ["ns"]).select(F.col("ns"), "cell", F.col("node").alias("drawn"), "lo", "hi")
    hit = asked.join(cells, ["ns", "cell"]).filter("u >= lo and u < hi")
    return hit.select(*requests.columns, "drawn")


def negatives(requests: DataFrame, dist: DataFrame, excluded: DataFrame, count: int, seed: int, by: list[str]) -> DataFrame:
    """requests (by, ns) with count draws each, none of them excluded (ns, node): the distribution is that of the others.

    Drawing from the others gives what rejecting excluded draws does. A namespace of which nothing is left raises.
    """
    rest = dist.join(excluded.select("node").distinct(), "node", "left_anti").filter("prob > 0")
    rest = _shares(rest.select("ns", "node", "prob"))
    if requests.select("ns").distinct().join(rest.select("ns").distinct(), "ns", "left_anti").limit(1).count():
        raise ValueError("all nodes are excluded")
    asked = requests.select(*by, "ns", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    return draw(asked, rest, uniform(seed, *by, "ns", "draw"))


def redraw(requests: DataFrame, dist: DataFrame, known: DataFrame, on: list[str], u: Callable[[int], Column]) -> DataFrame:
    """requests (on, ns, ...) with drawn: the first of the draws u(0), u(1), ... that is none of the known ones (on, drawn).

    Each round draws again only for those that met a known one. Raises if some still do after ROUNDS: their known ones are
    almost all of the namespace.
    """
    out, left = None, requests
    for k in range(ROUNDS):
        drawn = cut(draw(left, dist, u(k)).join(known.select(*on, "drawn").distinct().withColumn("_met", F.lit(1)), [*on, "drawn"], "left"))
        good = drawn.filter("_met is null").select(*requests.columns, "drawn")
        out, left = good if out is None else out.union(good), drawn.filter("_met = 1").select(*requests.columns)
        if not left.limit(1).count():
            return out
    raise ValueError("almost all nodes are excluded")


def shared_negatives(nodes: DataFrame, dist: DataFrame, excluded: DataFrame, count: int, seed: int) -> DataFrame:
    """ns, draw, drawn: one list for each namespace of nodes"""
    requests = nodes.select(type_of(F.col("node")).alias("ns")).distinct()
    return negatives(requests, dist, excluded, count, seed, [])


def independent_negatives(nodes: DataFrame, dist: DataFrame, excluded: DataFrame, count: int, seed: int) -> DataFrame:
    """node, ns, draw, drawn: one list for each of nodes"""
    return negatives(nodes.select("node", type_of(F.col("node")).alias("ns")), dist, excluded, count, seed, ["node"])


def rank_neighbors(edges: DataFrame) -> DataFrame:
    """src, k, deg, dst: neighbors numbered from 0 by id"""
    by_src = Window.partitionBy("src")
    return edges.select("src", (F.row_number().over(by_src.orderBy("dst")) - 1).alias("k"), F.count("*").over(by_src).alias("deg"), "dst", "w")


def sample_neighbors(nodes: DataFrame, edges: DataFrame, count: int, seed: int, weighted: bool = False) -> DataFrame:
    """node, draw, nbr: all neighbors if count is negative or the degree, some of them without replacement if it is less, else draws with replacement.

    Without replacement, neighbors go by ascending -ln(u) / w, which draws as rejecting repeats does.
    """
    wanted = nodes.select(F.col("node").alias("src")).distinct()
    ranked = rank_neighbors(edges.join(wanted, "src", "left_semi"))
    key = -F.log(F.greatest(uniform(seed, "src", "dst"), F.lit(1e-12))) / (F.col("w") if weighted else F.lit(1.0))
    if count < 0:
        return ranked.select(F.col("src").alias("node"), F.col("k").alias("draw"), F.col("dst").alias("nbr"))
    order = F.row_number().over(Window.partitionBy("src").orderBy(key, "dst")) - 1
    some = ranked.withColumn("draw", F.when(F.col("deg") == count, F.col("k")).otherwise(order)).filter((F.col("deg") >= count) & (F.col("draw") < count))
    heads = ranked.filter((F.col("k") == 0) & (F.col("deg") < count)).select("src", "deg", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    again = next_neighbors(heads, ranked, uniform(seed, "src", "draw"), weighted)
    return some.select(F.col("src").alias("node"), "draw", F.col("dst").alias("nbr")).union(again.select("src", "draw", "dst"))


def next_neighbors(at: DataFrame, ranked: DataFrame, u: Column, weighted: bool, how: str = "inner") -> DataFrame:
    """at (src, deg, ...) with the neighbor dst that u draws, by number, or by the sums of weights; how: what becomes of rows without one (deg null). Keyed by source and place, so the draws from a frequent source spread out."""
    if not weighted:
        picked = at.withColumn("k", F.floor(u * F.col("deg")).cast("int"))
        return picked.join(ranked.select("src", "k", "dst"), ["src", "k"], how).select(*at.columns, "dst")
    by_src = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("w").over(by_src) / F.sum("w").over(Window.partitionBy("src"))
    table = ranked.withColumn("hi", F.when(F.col("k") == F.col("deg") - 1, 1.0).otherwise(share)).withColumn("n", F.col("deg"))
    table = table.withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy("src").orderBy("k")), F.lit(0.0)))
    cells = _cells(table, ["src"]).select("src", "cell", "dst", "lo", "hi")
    asked = at.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * F.col("deg")))
    cells = cells.withColumnsRenamed({"src": "_src", "cell": "_cell"})
    met = (F.col("src") == F.col("_src")) & (F.col("cell") == F.col("_cell")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
    return asked.join(cells, met, how).select(*at.columns, "dst")


def sample_instances(rows: DataFrame, index: str, total: int, count: int, seed: int) -> DataFrame:
    """draw and the row that it takes: count uniform draws with replacement from rows numbered 0 to total - 1 in column index"""
    draws = rows.sparkSession.range(count).select(F.col("id").alias("draw"))
    draws = draws.withColumn(index, F.floor(uniform(seed, "draw") * total).cast("long"))
    return draws.join(rows, index)


def within_interval(successes: int, draws: int, prob: float, sigmas: float = 2.81) -> bool:
    """Whether a count of draws is within so many standard deviations of its expectation"""
    return abs(successes - draws * prob) <= sigmas * math.sqrt(draws * prob * (1 - prob))
