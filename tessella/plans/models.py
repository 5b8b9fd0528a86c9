"""The model families: factorization machines with networks, attention over histories, two towers, and graph networks on sampled subgraphs.

Each model has fit, which makes steps over all rows, and its predictions and embeddings as DataFrames. Labels and features
that are null raise no error but drop out of joins; features that training did not meet add nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.lineage import cut
from tessella.functions.networks import Attention, FactorizationMachine, Network, SageLayer
from tessella.functions.vectors import dot, softmax, vector_sum
from tessella.operators import subgraphs
from tessella.operators.tensors import mean_aggregate
from tessella.plans.training import Dense, new_table, pool, scatter, update


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _grouped(features: DataFrame) -> DataFrame:
    return features if "grp" in features.columns else features.withColumn("grp", F.lit(0))


class DeepFm:
    """A binary target (row, y) from features (row, fid, grp, v): weights, products of groups, and a network."""

    def __init__(self, groups: int, dim: int = 8, hidden: tuple[int, ...] = (16,), joint: bool = False, seed: int = 0):
        self.groups, self.width, self.seed = groups, dim + 1, seed
        self.dense, self.table = Dense(FactorizationMachine(groups, dim, hidden, joint), seed), None

    def _scored(self, rows: DataFrame, features: DataFrame) -> DataFrame:
        return self.dense.forward(pool(rows, features, self.table, self.width, self.groups))

    def fit(self, labels: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> DeepFm:
        features = _grouped(features)
        if self.table is None:
            self.table = new_table(features.select("fid"), self.width, self.seed)
        for _ in range(steps):
            d = F.array(_sigmoid(F.col("h")[0]) - F.col("y"))
            grads = self.dense.backward(self._scored(labels, features).join(labels, "row").select("row", "x", d.alias("d")))
            self.table = update(self.table, scatter(grads, features, self.width), rate)
            self.dense.step(grads, rate)
        return self

    def predict(self, rows: DataFrame, features: DataFrame) -> DataFrame:
        """row, p"""
        return self._scored(rows, _grouped(features)).select("row", _sigmoid(F.col("h")[0]).alias("p"))


class Din(DeepFm):
    """A binary target from features by group: those of the user, then a candidate, then the items of its history.

    Each group of the history is one item, whose weight depends on the candidate. A group without known features is empty.
    """

    def __init__(self, user_groups: int, history: int, dim: int = 8, att_hidden: int = 8, hidden: tuple[int, ...] = (16,), seed: int = 0):
        self.groups, self.width, self.seed = user_groups + 1 + history, dim, seed
        self.dense, self.table = Dense(Attention(user_groups, history, dim, att_hidden, hidden), seed), None


class TwoTowers:
    """Users and items in one space. Of a row's items (row, item, col), column 0 was chosen; softmax over the row.

    User features are (row, fid, grp, v), item features (item, fid, grp, v). Without item layers, an item's vector is its own.
    """

    def __init__(self, dim: int = 8, layers: tuple[int, ...] = (8,), item_layers: tuple[int, ...] | None = None, user_groups: int = 1, item_groups: int = 1, seed: int = 0):
        items = layers if item_layers is None else item_layers
        self.dim, self.groups, self.seed, self.tables = dim, (user_groups, item_groups), seed, None
        self.towers = [Dense(Network((dim * g, *n), last=True), seed + k) for k, (g, n) in enumerate(zip(self.groups, (layers, items)))]

    def _input(self, side: int, features: DataFrame) -> DataFrame:
        return pool(features.select("row").distinct(), features, self.tables[side], self.dim, self.groups[side])

    def _side(self, side: int, features: DataFrame) -> DataFrame:
        return self.towers[side].forward(self._input(side, features))

    def _pulls(self, items: DataFrame, sides: list[DataFrame]) -> list[DataFrame]:
        """The gradients (row, d) of both sides' vectors"""
        g = F.col("p") - (F.col("col") == 0).cast("double")
        return self._dealt(self._chances(items, *sides).select("row", "item", "u", "i", g.alias("g")))

    def _dealt(self, scored: DataFrame) -> list[DataFrame]:
        """What the gradients g of scores (row, item, u, i, g) are for both sides"""
        size = self.towers[0].net.sizes[-1]
        return [scored.groupBy("row").agg(vector_sum("i", size, F.col("g")).alias("d")), scored.groupBy(F.col("item").alias("row")).agg(vector_sum("u", size, F.col("g")).alias("d"))]

    def _finish(self, grads: list[DataFrame], rate: float) -> None:
        """After a step of tables and towers, from the gradients of both sides' inputs"""

    def user_embeddings(self, features: DataFrame) -> DataFrame:
        return self._side(0, _grouped(features)).select("row", F.col("h").alias("vec"))

    def item_embeddings(self, features: DataFrame) -> DataFrame:
        return self._side(1, _grouped(features).withColumnRenamed("item", "row")).select(F.col("row").alias("item"), F.col("h").alias("vec"))

    @staticmethod
    def _chances(items: DataFrame, users: DataFrame, others: DataFrame) -> DataFrame:
        found = items.join(users.select("row", F.col("h").alias("u")), "row").join(others.select(F.col("row").alias("item"), F.col("h").alias("i")), "item")
        by_row = Window.partitionBy("row")  # one positive and the negatives
        e = F.exp(F.col("z") - F.max("z").over(by_row))
        return found.withColumn("z", dot(F.col("u"), F.col("i"))).withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(by_row))

    def predict(self, items: DataFrame, user_features: DataFrame, item_features: DataFrame) -> DataFrame:
        """items with p"""
        sides = self._side(0, _grouped(user_features)), self._side(1, _grouped(item_features).withColumnRenamed("item", "row"))
        return self._chances(items, *sides).select("row", "item", "col", "p")

    def fit(self, items: DataFrame, user_features: DataFrame, item_features: DataFrame, steps: int = 5, rate: float = 0.1) -> TwoTowers:
        given = [_grouped(user_features), _grouped(item_features).withColumnRenamed("item", "row")]
        if self.tables is None:
            self.tables = [new_table(f.select("fid"), self.dim, self.seed + 10 + k) for k, f in enumerate(given)]
        for _ in range(steps):
            sides = [cut(self._side(k, given[k])) for k in (0, 1)]
            pulls = self._pulls(items, sides)
            grads = [self.towers[k].backward(sides[k].join(pulls[k], "row")) for k in (0, 1)]
            self.tables = [update(self.tables[k], scatter(grads[k], given[k], self.dim), rate) for k in (0, 1)]
            for tower, grad in zip(self.towers, grads):
                tower.step(grad, rate)
            self._finish(grads, rate)
        return self


class Pass(NamedTuple):
    """What went into the mean of a layer's neighbors, and what the layer saw and gave: (row, x, h)"""

    given: DataFrame
    at: DataFrame


class GraphSage:
    """Vectors of nodes from their features (node, fid, v) and those of sampled neighbors, one layer for each fan-out.

    fit_pairs learns from pairs (src, dst, y) by inner products, fit_labels from (node, labels), all of one length: classes by
    softmax over 0/1 arrays with a single 1, or with multi_label each position by itself. A layer has one part for the node
    and one for its neighbors' mean; or, if pin, neighbors go through a layer before their mean, and another takes both.
    """

    def __init__(self, fanouts: list[int], width: int = 8, dim: int = 8, classes: int | None = None, multi_label: bool = False, seed: int = 0, pin: bool = False):
        self.fanouts, self.width, self.seed, self.multi_label, self.table = fanouts, width, seed, multi_label, None
        self.size = dim if pin else 2 * dim
        self.widths = [width] + [self.size] * (len(fanouts) - 1)
        self.near = [dim] * len(fanouts) if pin else self.widths
        self.before = [Dense(Network((w, dim), last=True), seed + 10 * k + 5) if pin else None for k, w in enumerate(self.widths)]
        nets = [Network((w + dim, dim), last=True) if pin else SageLayer(w, dim, k < len(fanouts) - 1) for k, w in enumerate(self.widths)]
        self.layers = [Dense(net, seed + 10 * k) for k, net in enumerate(nets)]
        self.top = Dense(Network((self.size, classes)), seed + 1000) if classes else None

    def _graph(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(row, node) of all levels, blocks, and features by row, written once"""
        levels, links = subgraphs.sample_levels(nodes, edges, self.fanouts, self.seed)
        index = cut(subgraphs.level_index(levels).select("level", F.col("idx").alias("row"), "node"))
        blocks = cut(subgraphs.blocks(levels, links, len(self.fanouts)))
        return index, blocks, cut(index.join(features, "node").select("row", "fid", F.lit(0).alias("grp"), "v"))

    def _forward(self, index: DataFrame, blocks: DataFrame, features: DataFrame) -> list[Pass]:
        at, seen = pool(index, features, self.table, self.width).withColumnRenamed("x", "h"), []
        for k, layer in enumerate(self.layers):
            given = cut(self.before[k].forward(at.select("row", F.col("h").alias("x")))) if self.before[k] else at
            vecs = given.select(F.col("row").alias("id"), F.col("h").alias("vec"))
            own = blocks.filter((F.col("block") == k) & (F.col("kind") == "self")).select("row").join(at.select("row", "h"), "row")
            near = blocks.filter((F.col("block") == k) & (F.col("kind") == "neigh")).select("row", "col", F.lit(1.0).alias("x"))
            mean = mean_aggregate(near, vecs, self.near[k]).withColumnRenamed("vec", "m")
            x = F.concat("h", F.coalesce("m", F.array_repeat(F.lit(0.0), self.near[k])))
            at = cut(layer.forward(own.join(mean, "row", "left").select("row", x.alias("x"))))
            seen.append(Pass(given, at))
        return seen

    def _backward(self, seen: list[Pass], d: DataFrame, blocks: DataFrame, features: DataFrame, rate: float) -> None:
        """A step from d (row, d), the gradients of the last layer's output"""
        for k in reversed(range(len(self.layers))):
            layer, width, before = self.layers[k], self.widths[k], self.before[k]
            grads = layer.backward(seen[k].at.join(d, "row"))
            rows = grads.filter("dx is not null")
            near = blocks.filter((F.col("block") == k) & (F.col("kind") == "neigh")).select("row", "col")
            degree = near.groupBy("row").agg(F.count("*").alias("n"))
            pulls = near.join(degree, "row").join(rows, "row").select(F.col("col").alias("row"), F.slice("dx", width + 1, self.near[k]).alias("g"), (1 / F.col("n")).alias("s"))
            if before:
                back = before.backward(seen[k].given.join(pulls.groupBy("row").agg(vector_sum("g", self.near[k], F.col("s")).alias("d")), "row"))
                pulls = back.filter("dx is not null").select("row", F.col("dx").alias("g"), F.lit(1.0).alias("s"))
                before.step(back, rate)
            parts = rows.select("row", F.slice("dx", 1, width).alias("g"), F.lit(1.0).alias("s")).unionByName(pulls)
            d = parts.groupBy("row").agg(vector_sum("g", width, F.col("s")).alias("d"))
            layer.step(grads, rate)
        self.table = update(self.table, scatter(d.withColumnRenamed("d", "dx"), features, self.width), rate)

    def _prepare(self, nodes: DataFrame, edges: DataFrame, features: DataFrame):
        graph = self._graph(nodes, edges, features)
        if self.table is None:
            self.table = new_table(features.select("fid"), self.width, self.seed)
        return graph, graph[0].filter("level = 0").select("row", "node")

    def embed(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
        """node, vec"""
        graph, seeds = self._prepare(nodes, edges, features)
        return self._forward(*graph)[-1].at.join(seeds, "row").select("node", F.col("h").alias("vec"))

    def _pulls_of_pairs(self, by_row: DataFrame, vecs: DataFrame) -> DataFrame:
        """row, d: the gradients of (row, h) that pairs (a, b, y) give by inner products"""
        found = by_row.join(vecs.toDF("a", "u"), "a").join(vecs.toDF("b", "v"), "b")
        found = found.withColumn("g", _sigmoid(dot(F.col("u"), F.col("v"))) - F.col("y"))
        pulls = found.select(F.col("a").alias("row"), F.col("v").alias("o"), "g").union(found.select("b", "u", "g"))
        return pulls.groupBy("row").agg(vector_sum("o", self.size, F.col("g")).alias("d"))

    def fit_pairs(self, pairs: DataFrame, edges: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> GraphSage:
        ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst"))
        (index, blocks, feats), seeds = self._prepare(ends, edges, features)
        by_row = pairs.join(seeds.toDF("a", "src"), "src").join(seeds.toDF("b", "dst"), "dst").select("a", "b", "y")
        for _ in range(steps):
            seen = self._forward(index, blocks, feats)
            self._backward(seen, self._pulls_of_pairs(by_row, seen[-1].at.select("row", "h")), blocks, feats, rate)
        return self

    def _chances(self) -> Column:
        return F.transform("h", _sigmoid) if self.multi_label else softmax(F.col("h"))

    def _pulls_of_labels(self, wanted: DataFrame, vecs: DataFrame, rate: float) -> DataFrame:
        """row, d: the gradients of (row, h) that labels (row, labels) give, after a step of the top layer"""
        given = self.top.forward(vecs.select("row", F.col("h").alias("x"))).join(wanted, "row")
        grads = self.top.backward(given.select("row", "x", F.zip_with(self._chances(), "labels", lambda p, y: p - y).alias("d")))
        self.top.step(grads, rate)
        return grads.filter("dx is not null").select("row", F.col("dx").alias("d"))

    def fit_labels(self, labels: DataFrame, edges: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> GraphSage:
        (index, blocks, feats), seeds = self._prepare(labels, edges, features)
        wanted = labels.join(seeds, "node").select("row", "labels")
        for _ in range(steps):
            seen = self._forward(index, blocks, feats)
            self._backward(seen, self._pulls_of_labels(wanted, seen[-1].at, rate), blocks, feats, rate)
        return self

    def fit_both(self, labels: DataFrame, pairs: DataFrame, edges: DataFrame, features: DataFrame, weight: float = 0.0, steps: int = 5, rate: float = 0.1) -> GraphSage:
        """From labels and, by weight, from pairs"""
        ends = labels.select("node").union(pairs.select("src")).union(pairs.select("dst"))
        (index, blocks, feats), seeds = self._prepare(ends, edges, features)
        wanted = labels.join(seeds, "node").select("row", "labels")
        by_row = pairs.join(seeds.toDF("a", "src"), "src").join(seeds.toDF("b", "dst"), "dst").select("a", "b", "y")
        for _ in range(steps):
            seen = self._forward(index, blocks, feats)
            d = total_pulls([self._pulls_of_labels(wanted, seen[-1].at, rate), scaled(self._pulls_of_pairs(by_row, seen[-1].at.select("row", "h")), weight)], self.size)
            self._backward(seen, d, blocks, feats, rate)
        return self

    def predict(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
        """node, p: an array of probabilities"""
        graph, seeds = self._prepare(nodes, edges, features)
        last = self._forward(*graph)[-1].at.select("row", F.col("h").alias("x"))
        return self.top.forward(last).join(seeds, "row").select("node", self._chances().alias("p"))


def scaled(pulls: DataFrame, weight: float) -> DataFrame:
    return pulls.select("row", F.transform("d", lambda x: x * weight).alias("d"))


def total_pulls(parts: list[DataFrame], size: int) -> DataFrame:
    """row, d: the sums of gradients (row, d)"""
    every = parts[0].select("row", "d")
    for part in parts[1:]:
        every = every.union(part.select("row", "d"))
    return every.groupBy("row").agg(vector_sum("d", size).alias("d"))
