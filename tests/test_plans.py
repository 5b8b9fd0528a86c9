"""Instances by their shapes, and embeddings by a loss that falls."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.ids import encode_id
from tessella.operators import graph, metrics
from tessella.plans import embeddings, instances
from tessella.sources import datasets


@pytest.fixture(scope="module")
def ring(spark):
    rows = [(i, (i - k) % 13, 1.0) for i in range(13) for k in (1, 2, 3)]
    return spark.createDataFrame(rows, "src long, dst long, w double").cache()


def test_subgraph_instances(spark, ring):
    features = spark.createDataFrame([(i, 10, 1.0) for i in range(12)], "node long, fid long, v double")
    nodes = spark.createDataFrame([(3,), (4,)], "node long")
    out = instances.unsupervised_subgraphs(ring, features, [2], num_neg=2)
    assert out["pairs"].filter("y = 1").count() == 39 and out["pairs"].filter("y = 0").count() == 26
    assert out["levels"].filter("level = 0").count() == 13 and out["blocks"].filter("kind = 'self'").count() == 13
    labels = nodes.select("node", F.array(F.lit(1)).alias("labels"))
    sup = instances.supervised_subgraphs(labels, ring, features, [3, 2])
    assert sup["labels"].count() == 2 and sup["blocks"].filter("block = 0 and kind = 'self'").count() > 2
    rows = ring.select("src", "dst", F.col("src").alias("node"), F.array(F.lit(1)).alias("labels"))
    assert instances.semi_supervised_subgraphs(rows, ring, features, [2], discard=1.0)["labels"].count() == 0
    dgi = instances.infomax(nodes, ring, features, [2])
    assert dgi["shuffled_features"].select("node").distinct().count() == dgi["levels"].select("node").distinct().count()
    views = instances.contrastive(nodes, ring, features, [3], drops=(0.0, 1.0), masks=(0.0, 1.0))
    assert views["left_blocks"].filter("kind = 'neigh'").count() == 6 and views["right_blocks"].filter("kind = 'neigh'").count() == 0
    assert views["right_features"].count() == 0 and len(instances.multi_view(nodes, ring, features, [1], [2])) == 6


def test_pair_instances(spark, ring):
    seqs = spark.createDataFrame([(1, [1, 2, 3])], "key long, nodes array<long>")
    freq = graph.node_frequency(ring)
    features = spark.createDataFrame([(1, 10, 1.0)], "node long, fid long, v double")
    assert instances.skip_gram(seqs, freq, 1, 2)["pairs"].count() == 4 + 8
    assert instances.skip_gram_with_features(seqs, freq, features, 1, 2)["features"].count() == 6
    edges = ring.select(encode_id(F.lit(1), F.col("src")).alias("src"), encode_id(F.lit(2), F.col("dst")).alias("dst"), "w")
    both = edges.union(edges.select("dst", "src", "w"))
    out = instances.bipartite_subgraphs(both, features, [2], 1, 2, num_neg=1)
    assert out["user_levels"].filter("level = 0").count() == 13 and out["pairs"].filter("y = 0").count() == 13
    samples = spark.createDataFrame([(0, 3, 7, 1.0), (0, 3, 8, 1.0), (1, 4, 7, 1.0)], "row long, item long, fid long, v double")
    items = spark.createDataFrame([(i, 5, 1.0) for i in range(13)], "node long, fid long, v double")
    tower = instances.two_tower(samples, freq, items, num_neg=3)
    assert tower["items"].count() == 8 and tower["items"].filter("col = 0").count() == 2


def test_joint_instances(spark, ring):
    edges = ring.select(encode_id(F.lit(1), F.col("src")).alias("src"), encode_id(F.lit(2), F.col("dst")).alias("dst"), "w")
    both = edges.union(edges.select("dst", "src", "w")).cache()
    user, item = 1 << 48, 2 << 48
    samples = spark.createDataFrame([(0, 1, user + 3, 1.0), (0, 1, item + 2, 1.0), (1, 0, user + 4, 1.0), (1, 0, item + 2, 1.0)], "row long, y int, fid long, v double").cache()
    features = spark.createDataFrame([(user + 3, 10, 1.0)], "node long, fid long, v double")
    out = instances.bipartite_graph_ranking(samples, both, features, [2], 1, 2, length=2, window=1, num_neg=1)
    assert {r.node for r in out["users"].collect()} == {user + 3, user + 4}
    kinds = out["pairs"].select(F.shiftright("src", 48).alias("s"), F.shiftright("dst", 48).alias("d")).distinct().collect()
    assert [tuple(k) for k in kinds] == [(1, 2)]
    assert out["user_levels"].filter("level = 0").count() >= 2 and out["item_levels"].filter("level = 0").count() >= 1
    freq = graph.node_frequency(edges).filter(F.shiftright("node", 48) == 2)
    tower = instances.graph_two_tower(samples.filter(F.shiftright("fid", 48) == 1).withColumn("item", F.lit(item + 2)), both, features, freq, [2], 1, num_neg=3)
    assert tower["items"].count() == 8 and tower["levels"].filter("level = 0").count() == 2
    with pytest.raises(Exception, match="not one id of type 9"):
        instances.node_of_rows(samples, 9).collect()


def test_citations(spark, tmp_path):
    (tmp_path / "content").write_text("b\t1\t0\t1\tmaths\na\t0\t1\t0\tart\n")
    (tmp_path / "cites").write_text("a\tb\nb\ta\na\tz\n")
    out = datasets.read_citations(spark, str(tmp_path / "content"), str(tmp_path / "cites"))
    assert sorted(map(tuple, out["edges"].collect())) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert sorted((r.node, r.fid, round(r.v, 4)) for r in out["features"].collect()) == [(0, 1, 1.0), (1, 0, 0.5), (1, 2, 0.5)]
    assert sorted((r.node, r.labels) for r in out["labels"].collect()) == [(0, [0]), (1, [1])]
    x = spark.createDataFrame([(i, 1, float(i % 2)) for i in range(4)] + [(9, 1, 5.0), (9, 2, 3.0)], "node long, fid long, v double")
    done = {(r.node, r.fid): r.v for r in datasets.standardize(x, x.filter("node < 9")).collect()}
    assert done[0, 1] == -1 and done[1, 1] == 1 and done[9, 1] == 9 and done[9, 2] == 3


def test_embeddings(spark, ring):
    freq = graph.node_frequency(ring)
    pairs = ring.select("src", "dst", F.lit(1).alias("y")).union(ring.select("src", ((F.col("dst") + 6) % 13).alias("dst"), F.lit(0).alias("y"))).cache()
    nodes = freq.select("node")
    before = embeddings.loss(pairs, embeddings.initial(nodes, 8, 0), embeddings.initial(nodes, 8, 1))
    w_in, w_out = embeddings.train(pairs, nodes, dim=8, steps=8, rate=3.0)
    assert embeddings.loss(pairs, w_in, w_out) < before
    assert metrics.auc(embeddings.predict(pairs, w_in, w_out).select(F.col("p").alias("score"), "y")).first().auc > 0.5
