"""Models that learn a graph by itself, or along with ranking: infomax, contrast of views, two sides, side information, joint models.

All are steps over the whole table, but for contrast, which compares within batches. Nodes without features have vectors of zeros
before the first layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.lineage import cut
from tessella.functions.networks import FactorizationMachine, Network
from tessella.functions.vectors import dot, l2_normalize, softmax, vector_sum
from tessella.operators import graph, pairs, sampling, subgraphs
from tessella.operators.tensors import weighted_average
from tessella.plans import objectives
from tessella.plans.models import DeepFm, GraphSage, TwoTowers, _grouped, scaled, total_pulls
from tessella.plans.objectives import Readout, sigmoid
from tessella.plans.training import Dense, new_table, pool, scatter, update

Graph = tuple[DataFrame, DataFrame, DataFrame]


def views(graphs: list[Graph]) -> Graph:
    """One graph of several that share nothing: their rows are numbered apart, and view, in the index, tells them."""

    def apart(df: DataFrame, k: int, *cols: str) -> DataFrame:
        return df.withColumns({c: F.col(c) * len(graphs) + k for c in cols})

    index, blocks, feats = ([], [], [])
    for k, (i, b, f) in enumerate(graphs):
        index.append(apart(i, k, "row").withColumn("view", F.lit(k)))
        blocks.append(apart(b, k, "row", "col"))
        feats.append(apart(f, k, "row"))

    def joined(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return cut(out)

    return joined(index), joined(blocks), joined(feats)


def shuffled(given: Graph, edges: DataFrame, features: DataFrame, seed: int) -> Graph:
    """The graph with each node's features replaced by those of a random node of its namespace"""
    index, blocks, _ = given
    dist = sampling.negative_distribution(graph.node_frequency(edges), sampling.UNIFORM)
    moved = pairs.global_shuffle(index.select("node").distinct(), dist, seed)
    others = features.select(F.col("node").alias("drawn"), "fid", "v")
    return index, blocks, cut(index.join(moved, "node").join(others, "drawn").select("row", "fid", F.lit(0).alias("grp"), "v"))


class _Encoder:
    """A GraphSage on a graph and its shuffled copy"""

    def __init__(self, sage: GraphSage, nodes: DataFrame, edges: DataFrame, features: DataFrame):
        given, _ = sage._prepare(nodes, edges, features)
        self.sage, self.graph = sage, views([given, shuffled(given, edges, features, sage.seed)])
        self.seeds = self.graph[0].filter("level = 0").select("row", "view", "node")

    def forward(self) -> tuple[DataFrame, DataFrame]:
        """(row, h, y) of the seeds and of their shuffled copies, y being 1 for the former; and those of the former alone"""
        self.seen = self.sage._forward(*self.graph)
        rows = self.seen[-1].at.select("row", "h").join(self.seeds, "row").withColumn("y", 1 - F.col("view"))
        return rows, rows.filter("y = 1")

    def step(self, parts: list[DataFrame], rate: float) -> None:
        self.sage._backward(self.seen, total_pulls(parts, self.sage.size), *self.graph[1:], rate)


class Infomax:
    """Nodes' vectors that a summary of all of them tells from those of shuffled features"""

    def __init__(self, fanouts: list[int], width: int = 8, dim: int = 8, seed: int = 0):
        self.sage = GraphSage(fanouts, width, dim, seed=seed)
        self.readout = Readout(self.sage.size, seed + 500)

    def fit(self, nodes: DataFrame, edges: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> Infomax:
        encoder = _Encoder(self.sage, nodes, edges, features)
        for _ in range(steps):
            rows, own = encoder.forward()
            encoder.step(self.readout.pull(own, [rows], rate), rate)
        return self

    def loss(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> float:
        """The mean cross-entropy"""
        rows, own = _Encoder(self.sage, nodes, edges, features).forward()
        return self.readout.scores(own, rows).agg(F.avg(objectives.cross_entropy(F.col("z"), F.col("y")))).first()[0]

    def embed(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
        """node, vec"""
        return self.sage.embed(nodes, edges, features)


def _sum_of_embeddings(sages: list[GraphSage], nodes: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
    a, b = (s.embed(nodes, edges, features) for s in sages)
    return a.join(b.withColumnRenamed("vec", "other"), "node").select("node", F.zip_with("vec", "other", lambda x, y: x + y).alias("vec"))


class MultiView:
    """Two encoders of different fan-outs; each one's vectors are told from shuffled ones by the summary of the other's. Vectors are the sums of both."""

    def __init__(self, fanouts: list[int], enhanced: list[int], width: int = 8, dim: int = 8, seed: int = 0):
        self.sages = [GraphSage(f, width, dim, seed=seed + 100 * k) for k, f in enumerate((fanouts, enhanced))]
        self.readouts = [Readout(s.size, seed + 500 + k) for k, s in enumerate(self.sages)]

    def fit(self, nodes: DataFrame, edges: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> MultiView:
        encoders = [_Encoder(s, nodes, edges, features) for s in self.sages]
        for _ in range(steps):
            (rows_a, own_a), (rows_b, own_b) = (e.forward() for e in encoders)
            of_a, by_a = self.readouts[0].pull(own_a, [rows_b], rate)
            of_b, by_b = self.readouts[1].pull(own_b, [rows_a], rate)
            encoders[0].step([of_a, by_b], rate)
            encoders[1].step([of_b, by_a], rate)
        return self

    def embed(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
        """node, vec"""
        return _sum_of_embeddings(self.sages, nodes, edges, features)


class NodeInfograph:
    """One encoder learns labels, the other infomax; the summary of the second also tells the first one's vectors from shuffled ones. Vectors are the sums of both."""

    def __init__(self, fanouts: list[int], classes: int, multi_label: bool = False, width: int = 8, dim: int = 8, seed: int = 0):
        self.labelled = GraphSage(fanouts, width, dim, classes, multi_label, seed)
        self.free = GraphSage(fanouts, width, dim, seed=seed + 100)
        self.readout = Readout(self.free.size, seed + 500)

    def fit(self, labels: DataFrame, edges: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> NodeInfograph:
        """labels: node, labels"""
        encoders = [_Encoder(s, labels, edges, features) for s in (self.labelled, self.free)]
        wanted = encoders[0].seeds.filter("view = 0").join(labels, "node").select("row", "labels")
        for _ in range(steps):
            (rows, own), (free_rows, free_own) = (e.forward() for e in encoders)
            d_free, d_rows, d_mixed = self.readout.pull(free_own, [free_rows, rows], rate)
            encoders[0].step([self.labelled._pulls_of_labels(wanted, own, rate), d_mixed], rate)
            encoders[1].step([d_free, d_rows], rate)
        return self

    def predict(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
        """node, p"""
        return self.labelled.predict(nodes, edges, features)

    def embed(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
        """node, vec"""
        return _sum_of_embeddings([self.labelled, self.free], nodes, edges, features)


class Contrastive:
    """Nodes' vectors in two views, thinned at rates of their own, that are alike for one node and unlike within a batch"""

    def __init__(self, fanouts: list[int], width: int = 8, dim: int = 8, layers: int = 2, tau: float = 0.4, batch: int = 256,
                 drops: tuple[float, float] = (0.2, 0.4), masks: tuple[float, float] = (0.3, 0.4), seed: int = 0):
        self.sage = GraphSage(fanouts, width, dim, seed=seed)
        self.head = Dense(Network((self.sage.size,) * (layers + 1), elu=True), seed + 500)
        self.tau, self.batch, self.rates = tau, batch, tuple(zip(drops, masks))

    def _views(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> Graph:
        """Both views have the sampled levels of one graph, so a node has one number in both."""
        levels, links = subgraphs.sample_levels(nodes, edges, self.sage.fanouts, self.sage.seed)
        index = cut(subgraphs.level_index(levels).select("level", F.col("idx").alias("row"), "node"))
        graphs = []
        for k, (drop, mask) in enumerate(self.rates):
            seed = self.sage.seed + 100 * k
            kept = subgraphs.drop_edges(links, drop, seed) if drop else links
            feats = index.join(subgraphs.mask_features(features, mask, seed) if mask else features, "node").select("row", "fid", F.lit(0).alias("grp"), "v")
            graphs.append((index, subgraphs.blocks(levels, kept, len(self.sage.fanouts)), feats))
        return views(graphs)

    def _compared(self, given: Graph) -> tuple[list, DataFrame, DataFrame]:
        seen = self.sage._forward(*given)
        seeds = given[0].filter("level = 0").select("row", "view")
        out = cut(self.head.forward(seen[-1].at.select("row", F.col("h").alias("x"))))
        rows = out.join(seeds, "row").withColumn("pair", F.floor(F.col("row") / 2))
        sides = rows.filter("view = 0").select(F.col("pair").alias("row"), F.col("h").alias("l")).join(rows.filter("view = 1").select(F.col("pair").alias("row"), F.col("h").alias("r")), "row")
        return seen, out, cut(objectives.contrastive(sides.withColumn("batch", F.floor(F.col("row") / self.batch)), self.tau))

    def fit(self, nodes: DataFrame, edges: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> Contrastive:
        self.sage._prepare(nodes, edges, features)
        given = self._views(nodes, edges, features)
        for _ in range(steps):
            seen, out, found = self._compared(given)
            d = found.select((F.col("row") * 2).alias("row"), F.col("dl").alias("d")).union(found.select(F.col("row") * 2 + 1, "dr"))
            grads = self.head.backward(out.join(d, "row"))
            self.sage._backward(seen, grads.filter("dx is not null").select("row", F.col("dx").alias("d")), *given[1:], rate)
            self.head.step(grads, rate)
        return self

    def loss(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> float:
        return self._compared(self._views(nodes, edges, features))[2].agg(F.avg("loss")).first()[0]

    def embed(self, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
        """node, vec, from the whole graph"""
        return self.sage.embed(nodes, edges, features)


class BipartiteSage:
    """An encoder for each side of pairs (src, dst, y). Scores are inner products, or those of a network over both vectors.

    They learn by cross-entropy, or, if pairwise, by the squares of how far each positive falls short of a lead of 1 over each negative.
    """

    def __init__(self, fanouts: list[int], width: int = 8, dim: int = 8, pairwise: bool = False, decoder: tuple[int, ...] | None = None, seed: int = 0):
        self.sides = [GraphSage(fanouts, width, dim, seed=seed + 100 * k) for k in (0, 1)]
        self.pairwise, size = pairwise, self.sides[0].size
        self.decoder = None if decoder is None else Dense(Network((2 * size, *decoder, 1)), seed + 500)

    def _scored(self, by_row: DataFrame, vecs: list[DataFrame]) -> DataFrame:
        """by_row (row, a, b, ...) with u, v, z, and x where there is a decoder"""
        found = by_row.join(vecs[0].toDF("a", "u"), "a").join(vecs[1].toDF("b", "v"), "b")
        if self.decoder is None:
            return found.withColumn("z", dot(F.col("u"), F.col("v")))
        given = self.decoder.forward(found.select("row", F.concat("u", "v").alias("x")))
        return found.join(given.select("row", "x", F.col("h")[0].alias("z")), "row")

    def _rows(self, found: DataFrame, seeds: list[DataFrame]) -> DataFrame:
        ends = found.join(seeds[0].toDF("a", "src"), "src").join(seeds[1].toDF("b", "dst"), "dst")
        return cut(ends.withColumn("row", F.monotonically_increasing_id()))

    def _prepared(self, found: DataFrame, edges: DataFrame, features: DataFrame) -> tuple[list, DataFrame]:
        graphs, seeds = zip(*[s._prepare(found.select(F.col(c).alias("node")), edges, features) for s, c in zip(self.sides, ("src", "dst"))])
        return list(graphs), self._rows(found, list(seeds))

    def fit(self, found: DataFrame, edges: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> BipartiteSage:
        graphs, by_row = self._prepared(found, edges, features)
        size = self.sides[0].size
        for _ in range(steps):
            seen = [s._forward(*g) for s, g in zip(self.sides, graphs)]
            scored = cut(self._scored(by_row, [s[-1].at.select("row", "h") for s in seen]))
            scored = objectives.pairwise_square(scored) if self.pairwise else scored.withColumn("g", sigmoid(F.col("z")) - F.col("y"))
            if self.decoder is None:
                each = scored.select("a", "b", F.transform("v", lambda x: x * F.col("g")).alias("du"), F.transform("u", lambda x: x * F.col("g")).alias("dv"))
            else:
                grads = self.decoder.backward(scored.select("row", "x", F.array("g").alias("d")))
                back = grads.filter("dx is not null").select("row", F.slice("dx", 1, size).alias("du"), F.slice("dx", size + 1, size).alias("dv"))
                each = scored.select("row", "a", "b").join(back, "row")
            for side, s, g, key, d in zip(self.sides, seen, graphs, ("a", "b"), ("du", "dv")):
                side._backward(s, each.groupBy(F.col(key).alias("row")).agg(vector_sum(d, size).alias("d")), *g[1:], rate)
            if self.decoder is not None:
                self.decoder.step(grads, rate)
        return self

    def predict(self, found: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
        """found (src, dst, ...) with the score z"""
        graphs, by_row = self._prepared(found, edges, features)
        vecs = [s._forward(*g)[-1].at.select("row", "h") for s, g in zip(self.sides, graphs)]
        return self._scored(by_row, vecs).select(*found.columns, "z")


class Eges:
    """Vectors of nodes (node, fid, grp, v) from groups of features, weighed by a softmax of weights of the node's own; pairs (src, dst, y) by inner products with dst's output vectors"""

    def __init__(self, groups: int, dim: int = 8, seed: int = 0):
        self.groups, self.dim, self.seed, self.table = groups, dim, seed, None

    def _hidden(self, nodes: DataFrame, features: DataFrame) -> DataFrame:
        """row, x (the groups' vectors side by side), weights, vec. A node that training did not meet weighs its groups alike."""
        rows = nodes.select(F.col("node").alias("row")).distinct()
        found = pool(rows, _grouped(features.withColumnRenamed("node", "row")), self.table, self.dim, self.groups)
        own = self.weights.select(F.col("id").alias("row"), F.col("vec").alias("weights"))
        found = found.join(own, "row", "left").withColumn("weights", F.coalesce("weights", F.array_repeat(F.lit(0.0), self.groups)))
        mean = weighted_average(found.select("row", "weights", F.col("x").alias("vec")), self.groups, self.dim)
        return found.join(mean, "row")

    def fit(self, found: DataFrame, features: DataFrame, steps: int = 5, rate: float = 0.1) -> Eges:
        if self.table is None:
            self.table = new_table(features.select("fid"), self.dim, self.seed)
            self.weights = new_table(found.select("src"), self.groups, self.seed + 1)
            self.out = new_table(found.select("dst"), self.dim, self.seed + 2)
        nodes, p = found.select(F.col("src").alias("node")).distinct(), softmax(F.col("weights"))
        for _ in range(steps):
            rows = cut(self._hidden(nodes, features))
            met = found.join(rows.select(F.col("row").alias("src"), F.col("vec").alias("u")), "src").join(self.out.select(F.col("id").alias("dst"), F.col("vec").alias("o")), "dst")
            met = met.withColumn("g", sigmoid(dot(F.col("u"), F.col("o"))) - F.col("y"))
            d_out = met.groupBy(F.col("dst").alias("id")).agg(vector_sum("u", self.dim, F.col("g")).alias("g"))
            pull = rows.withColumn("p", p).join(met.groupBy(F.col("src").alias("row")).agg(vector_sum("o", self.dim, F.col("g")).alias("d")), "row")
            groups = F.sequence(F.lit(0), F.lit(self.groups - 1))
            along = F.transform(groups, lambda k: dot(F.slice("x", k * self.dim + 1, F.lit(self.dim)), F.col("d")))
            pull = pull.withColumn("along", along).withColumn("mean", dot(F.col("p"), F.col("along")))
            d_weights = pull.select(F.col("row").alias("id"), F.zip_with("p", "along", lambda q, c: q * (c - F.col("mean"))).alias("g"))
            dx = F.flatten(F.transform("p", lambda q: F.transform("d", lambda v: v * q)))
            d_table = scatter(pull.select("row", dx.alias("dx")), _grouped(features.withColumnRenamed("node", "row")), self.dim)
            self.table, self.weights, self.out = (update(t, cut(g), rate) for t, g in ((self.table, d_table), (self.weights, d_weights), (self.out, d_out)))
        return self

    def embed(self, nodes: DataFrame, features: DataFrame) -> DataFrame:
        """node, vec"""
        return self._hidden(nodes, features).select(F.col("row").alias("node"), "vec")

    def predict(self, found: DataFrame, features: DataFrame) -> DataFrame:
        """found with p"""
        rows = self._hidden(found.select(F.col("src").alias("node")), features)
        met = found.join(rows.select(F.col("row").alias("src"), F.col("vec").alias("u")), "src").join(self.out.select(F.col("id").alias("dst"), F.col("vec").alias("o")), "dst")
        return met.select(*found.columns, sigmoid(dot(F.col("u"), F.col("o"))).alias("p"))


class GraphDeepFm:
    """Ranking (row, y) by features (row, fid, grp, v) and by the graph's vectors of the row's user, and of its item if two_sided.

    The graph learns too, by weight, from pairs (src, dst, y): users' vectors with items' own, or with the graph's vectors of items.
    """

    def __init__(self, groups: int, fanouts: list[int], width: int = 8, dim: int = 8, hidden: tuple[int, ...] = (16,), two_sided: bool = False, weight: float = 1.0, pin: bool = False, seed: int = 0):
        self.sides = [GraphSage(fanouts, width, dim, seed=seed + 100 * k, pin=pin) for k in range(1 + two_sided)]
        self.keys, self.size = ["user", "item"][: len(self.sides)], self.sides[0].size
        self.groups, self.width, self.weight, self.seed, self.out = groups, dim + 1, weight, seed, None
        self.dense = Dense(FactorizationMachine(groups, dim, hidden, True, self.size * len(self.sides)), seed + 500)
        self.table = None

    def _vectors(self, graphs: list[Graph]) -> tuple[list, list[DataFrame]]:
        """What the encoders saw, and (row, key, h) of their seeds"""
        seen = [s._forward(*g) for s, g in zip(self.sides, graphs)]
        return seen, [p[-1].at.select("row", "h").join(g[0].filter("level = 0").select("row", "node"), "row") for p, g in zip(seen, graphs)]

    def _ranked(self, ends: DataFrame, features: DataFrame, vecs: list[DataFrame]) -> DataFrame:
        """row, x, h, with what the graph knows of the row's ends behind its features"""
        found, parts = pool(ends, features, self.table, self.width, self.groups).join(ends, "row"), ["x"]
        for k, (key, v) in enumerate(zip(self.keys, vecs)):
            found = found.join(v.select(F.col("node").alias(key), F.col("h").alias(f"g{k}")), key)
            parts.append(f"g{k}")
        return self.dense.forward(found.select("row", F.concat(*parts).alias("x")))

    def _prepared(self, nodes: list[DataFrame], edges: DataFrame, features: DataFrame) -> list[Graph]:
        return [s._prepare(n.distinct(), edges, features)[0] for s, n in zip(self.sides, nodes)]

    def fit(self, labels: DataFrame, ends: DataFrame, features: DataFrame, met: DataFrame, edges: DataFrame, node_features: DataFrame, steps: int = 5, rate: float = 0.1) -> GraphDeepFm:
        """labels: row, y; ends: row, user and item; met: src, dst, y"""
        features = _grouped(features)
        nodes = [ends.select(F.col(k).alias("node")).union(met.select(c)) for k, c in zip(self.keys, ("src", "dst"))]
        graphs = self._prepared(nodes, edges, node_features)
        if self.table is None:
            self.table = new_table(features.select("fid"), self.width, self.seed)
            self.out = new_table(met.select("dst"), self.size, self.seed + 1)
        first = self.groups * self.width
        for _ in range(steps):
            seen, vecs = self._vectors(graphs)
            d = F.array(sigmoid(F.col("h")[0]) - F.col("y"))
            grads = self.dense.backward(self._ranked(ends, features, vecs).join(labels, "row").select("row", "x", d.alias("d")))
            back = grads.filter("dx is not null").join(ends, "row")
            pulls = [[back.select(F.col(k).alias("node"), F.slice("dx", first + 1 + i * self.size, self.size).alias("d"))] for i, k in enumerate(self.keys)]
            other = vecs[1].select("node", "h") if len(vecs) > 1 else self.out.select("id", "vec")
            scored = met.join(vecs[0].select(F.col("node").alias("src"), F.col("h").alias("u")), "src").join(other.toDF("dst", "v"), "dst")
            scored = cut(scored.withColumn("g", self.weight * (sigmoid(dot(F.col("u"), F.col("v"))) - F.col("y"))))
            pulls[0].append(scored.select(F.col("src").alias("node"), F.transform("v", lambda x: x * F.col("g")).alias("d")))
            by_dst = scored.select(F.col("dst").alias("node"), F.transform("u", lambda x: x * F.col("g")).alias("d"))
            if len(vecs) > 1:
                pulls[1].append(by_dst)
            else:
                self.out = update(self.out, by_dst.groupBy(F.col("node").alias("id")).agg(vector_sum("d", self.size).alias("g")), rate)
            for side, s, g, v, parts in zip(self.sides, seen, graphs, vecs, pulls):
                by_row = [p.join(v.select("node", "row"), "node") for p in parts]
                side._backward(s, total_pulls(by_row, self.size), *g[1:], rate)
            self.table = update(self.table, scatter(grads.filter("dx is not null").select("row", "dx"), features, self.width), rate)
            self.dense.step(grads, rate)
        return self

    def predict(self, ends: DataFrame, features: DataFrame, edges: DataFrame, node_features: DataFrame) -> DataFrame:
        """row, p"""
        graphs = self._prepared([ends.select(F.col(k).alias("node")) for k in self.keys], edges, node_features)
        return self._ranked(ends, _grouped(features), self._vectors(graphs)[1]).select("row", sigmoid(F.col("h")[0]).alias("p"))

    def user_embeddings(self, nodes: DataFrame, edges: DataFrame, node_features: DataFrame) -> DataFrame:
        """node, vec: what a cache of users' vectors would hold"""
        return self.sides[0].embed(nodes, edges, node_features)


class GraphTowers(TwoTowers):
    """Two towers, the user's of which also sees the graph's vector of the row's user"""

    def __init__(self, fanouts: list[int], dim: int = 8, layers: tuple[int, ...] = (8,), item_layers: tuple[int, ...] | None = None, user_groups: int = 1, item_groups: int = 1, seed: int = 0):
        super().__init__(dim, layers, item_layers, user_groups, item_groups, seed)
        self.sage = GraphSage(fanouts, dim, dim, seed=seed + 200)
        self.towers[0] = Dense(Network((dim * user_groups + self.sage.size, *layers), last=True), seed)

    def set_graph(self, users: DataFrame, edges: DataFrame, node_features: DataFrame) -> GraphTowers:
        """users: row, node. To be called before fit and before predictions for other rows."""
        self.users = users
        self.graph, self.seeds = self.sage._prepare(users.select("node").distinct(), edges, node_features)
        return self

    def _input(self, side: int, features: DataFrame) -> DataFrame:
        given = super()._input(side, features)
        if side:
            return given
        self.seen = self.sage._forward(*self.graph)
        own = self.seen[-1].at.select("row", "h").join(self.seeds, "row").drop("row").join(self.users, "node")
        return given.join(own, "row").select("row", F.concat("x", "h").alias("x"))

    def _finish(self, grads: list[DataFrame], rate: float) -> None:
        first = self.dim * self.groups[0]
        d = grads[0].filter("dx is not null").join(self.users, "row").select("node", F.slice("dx", first + 1, self.sage.size).alias("d"))
        self.sage._backward(self.seen, total_pulls([d.join(self.seeds, "node")], self.sage.size), *self.graph[1:], rate)


class SelfTraining(TwoTowers):
    """Two towers whose vectors have length 1 and whose scores are over tau, which also learn, from users and items that were not chosen,
    to be surer where they are sure. pseudo: row, item."""

    def __init__(self, dim: int = 8, layers: tuple[int, ...] = (8,), tau: float = 0.1, upper: float = 0.69, lower: float = 0.31, seed: int = 0):
        super().__init__(dim, layers, seed=seed)
        self.tau, self.bounds, self.pseudo = tau, (upper, lower), None

    def set_pseudo(self, pseudo: DataFrame) -> SelfTraining:
        self.pseudo = pseudo
        return self

    def _units(self, rows: DataFrame, by: float = 1.0) -> DataFrame:
        return rows.withColumn("h", F.transform(l2_normalize(F.col("h")), lambda x: x / by))

    def user_embeddings(self, features: DataFrame) -> DataFrame:
        return super().user_embeddings(features).withColumn("vec", l2_normalize(F.col("vec")))

    def item_embeddings(self, features: DataFrame) -> DataFrame:
        return super().item_embeddings(features).withColumn("vec", l2_normalize(F.col("vec")))

    def predict(self, items: DataFrame, user_features: DataFrame, item_features: DataFrame) -> DataFrame:
        """items with p"""
        sides = self._side(0, _grouped(user_features)), self._side(1, _grouped(item_features).withColumnRenamed("item", "row"))
        return self._chances(items, self._units(sides[0], self.tau), self._units(sides[1])).select("row", "item", "col", "p")

    def _pulls(self, items: DataFrame, sides: list[DataFrame]) -> list[DataFrame]:
        units = [self._units(s) for s in sides]
        chances = self._chances(items, self._units(sides[0], self.tau), units[1])
        g = (F.col("p") - (F.col("col") == 0).cast("double")) / self.tau
        own = chances.select("row", "item", F.transform("u", lambda x: x * self.tau).alias("u"), "i", g.alias("g"))
        if self.pseudo is not None:
            met = self.pseudo.join(units[0].select("row", F.col("h").alias("u")), "row").join(units[1].select(F.col("row").alias("item"), F.col("h").alias("i")), "item")
            surer = objectives.self_training(dot(F.col("u"), F.col("i")), *self.bounds)[1]
            own = own.union(met.select("row", "item", "u", "i", surer.alias("g")))
        found = self._dealt(own)
        return [s.select("row", "h").join(p, "row").select("row", objectives.normalized_pull("h", "d").alias("d")) for s, p in zip(sides, found)]


__all__ = ["BipartiteSage", "Contrastive", "DeepFm", "Eges", "GraphDeepFm", "GraphTowers", "Infomax", "MultiView", "NodeInfograph", "SelfTraining", "scaled", "views"]
