"""Networks by finite differences, models by a loss that falls to what can be learned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.networks import Attention, FactorizationMachine, Network, SageLayer
from tessella.operators import metrics
from tessella.plans import models


@pytest.mark.parametrize("net, width", [
    (Network((4, 3, 2)), 4), (Network((4, 3), last=True), 4), (Network((4,)), 4), (SageLayer(2, 3), 4),
    (FactorizationMachine(2, 3, (4,)), 8), (FactorizationMachine(2, 3, (4,), joint=True), 8),
    (Network((4, 3, 2), last=True, sigmoid=True), 4), (Network((4, 3, 2), elu=True), 4),
    (FactorizationMachine(2, 3, (4,), joint=True, extra=2), 10), (Attention(1, 2, 2, 3, (4,)), 8),
])
def test_gradients(net, width):
    rng = np.random.default_rng(0)
    flat, x = net.initial(1) + 0.1, rng.normal(size=(5, width))
    out = net.outputs(flat, x)
    d = rng.normal(size=out[-1].shape)
    grad, dx = net.backward(flat, out, d)

    def by_difference(at, f):
        found = np.zeros(at.size)
        for k in range(at.size):
            step = np.zeros(at.size)
            step[k] = 1e-6
            found[k] = (f(at + step.reshape(at.shape)) - f(at - step.reshape(at.shape))) / 2e-6
        return found

    assert np.allclose(grad, by_difference(flat, lambda p: (net.outputs(p, x)[-1] * d).sum()), atol=1e-5)
    assert np.allclose(dx.ravel(), by_difference(x, lambda v: (net.outputs(flat, v)[-1] * d).sum()), atol=1e-5)


@pytest.mark.parametrize("joint", [False, True])
def test_deep_fm_learns_a_product_of_groups(spark, joint):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for _ in range(4) for a in (0, 1) for b in (0, 1))]
    features = spark.createDataFrame([(i, g * 10 + f, g, 1.0) for i, *fs in rows for g, f in enumerate(fs)], "row long, fid long, grp int, v double").cache()
    labels = spark.createDataFrame([(i, int(a == b)) for i, a, b in rows], "row long, y int").cache()
    model = models.DeepFm(2, 4, (8,), joint, seed=3).fit(labels, features, steps=12, rate=0.3)
    scored = model.predict(labels, features).join(labels, "row").select(F.col("p").alias("score"), "y")
    assert metrics.auc(scored).first().auc == 1.0
    unknown = model.predict(spark.createDataFrame([(99,)], "row long"), features)
    assert unknown.count() == 1 and 0 < unknown.first().p < 1


@pytest.mark.parametrize("item_layers", [None, ()])
def test_two_towers_prefer_the_chosen_item(spark, item_layers):
    users = spark.createDataFrame([(i, i % 3, 1.0) for i in range(9)], "row long, fid long, v double").cache()
    items = spark.createDataFrame([(i, (i + k) % 3, k) for i in range(9) for k in range(3)], "row long, item long, col int").cache()
    feats = spark.createDataFrame([(k, 100 + k, 1.0) for k in range(3)], "item long, fid long, v double").cache()
    model = models.TwoTowers(8, (8,), item_layers, seed=1).fit(items, users, feats, steps=8, rate=0.2)
    p = model.predict(items, users, feats)
    assert p.filter("col = 0").agg(F.avg("p")).first()[0] > 0.6
    assert model.user_embeddings(users).count() == 9 and model.item_embeddings(feats).count() == 3


def test_graph_sage(spark):
    # Two cliques; a node's own feature says nothing, those of its neighbors tell the clique.
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(10) for b in range(10) if a != b and a // 5 == b // 5], "src long, dst long, w double").cache()
    features = spark.createDataFrame([(i, 7 if i % 5 == 0 else i // 5, 1.0) for i in range(10)], "node long, fid long, v double").cache()
    labels = spark.createDataFrame([(i, [int(i < 5), int(i >= 5)]) for i in range(10)], "node long, labels array<int>").cache()
    model = models.GraphSage([4, 3], 4, 4, classes=2, seed=2).fit_labels(labels, edges, features, steps=6, rate=0.2)
    right = model.predict(labels, edges, features).join(labels, "node").filter("p[0] > 0.5 = (labels[0] = 1)")
    assert right.count() == 10
    pairs = spark.createDataFrame([(a, b, int(a // 5 == b // 5)) for a in range(10) for b in range(10) if a < b], "src long, dst long, y int")
    vecs = {r.node: np.array(r.vec) for r in models.GraphSage([4], 4, 4, seed=2).fit_pairs(pairs, edges, features, steps=6, rate=0.2).embed(labels, edges, features).collect()}
    same = np.mean([vecs[a] @ vecs[b] for a in range(10) for b in range(a) if a // 5 == b // 5])
    other = np.mean([vecs[a] @ vecs[b] for a in range(10) for b in range(a) if a // 5 != b // 5])
    assert len(vecs) == 10 and same > other


def test_attention(spark):
    net = Attention(1, 2, 2)
    x = np.array([[1.0, 2, 3, 4, 0, 0, 0, 0], [1, 2, 3, 4, 0, 0, 5, 6]])
    cand, hist, _, share, _ = net._parts(net.initial(0), x)
    assert share[0].tolist() == [0, 0] and share[1].tolist() == [0, 1]
    rows = [(i, g, 100 * (g > 0) + (i >> g) % 2) for i in range(8) for g in range(3)]
    features = spark.createDataFrame([(i, f, g, 1.0) for i, g, f in rows], "row long, fid long, grp int, v double").cache()
    labels = spark.createDataFrame([(i, (i >> 1) % 2) for i in range(8)], "row long, y int").cache()
    model = models.Din(1, 1, 4, seed=1).fit(labels, features, steps=4, rate=0.3)
    scored = model.predict(labels, features).join(labels, "row").select(F.col("p").alias("score"), "y")
    assert metrics.auc(scored).first().auc == 1.0
