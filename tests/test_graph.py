"""Operators on small graphs with known answers, and texts in and out."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions.ids import encode_id, shard_of, sub_of, type_of, types_in
from tessella.operators import graph, lookups, metrics, neighbors, pairs, sampling, subgraphs, tensors, walks
from tessella.plans.client import DeepClient, GraphClient
from tessella.sources import text
from tessella.streaming.parameters import ParameterTable, admit, expire, newest, stream_counts, warm_start


@pytest.fixture(scope="module")
def ring(spark):
    """13 nodes; i goes to the three before it."""
    rows = [(i, (i - k) % 13, 1.0 + k / 10) for i in range(13) for k in (1, 2, 3)]
    return spark.createDataFrame(rows, "src long, dst long, w double").cache()


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_ids(spark):
    rows = [(11, 10000, 3096224743827216), (1, 10, 281474976710666), (12, 0, 3377699720527872), (12, 10000, 3377699720537872)]
    df = spark.createDataFrame(rows, "g int, i long, id long")
    out = df.select(encode_id(F.col("g"), F.col("i")).alias("e"), type_of(F.col("id")).alias("g"), sub_of(F.col("id")).alias("i"), "id").collect()
    assert [(r.g, r.i, r.e) for r in out] == rows
    assert [r.type for r in types_in(df.select(F.col("id").alias("node"))).orderBy("type").collect()] == [1, 11, 12]
    assert spark.sql("select -1L as n").select(shard_of(F.col("n"), 7)).first()[0] == ((1 << 64) - 1) % 7


def test_statistics(ring):
    freq = graph.node_frequency(ring)
    assert freq.agg(F.count("*"), F.sum("freq")).first()[:] == (13, 52)
    assert graph.degrees(ring).filter("in_degree <> 3 or out_degree <> 3").count() == 0
    part = ring.filter(shard_of(F.col("src"), 2) == 0)
    assert graph.node_frequency(part).agg(F.count("*"), F.sum("freq")).first()[:] == (13, 28)
    known = {r.node: (r.in_degree, r.out_degree) for r in graph.degrees(part).collect()}
    assert (known[0], known[1]) == ((1, 3), (2, 0))
    assert graph.namespace_totals(freq).first()[:] == (0, 13, 52)
    assert sorted(r.idx for r in graph.dense_index(freq).collect()) == list(range(13))
    with pytest.raises(Exception, match="repeated node"):
        graph.check_unique(graph.adjacency(ring).union(graph.adjacency(ring))).collect()


def test_lookups(spark, ring):
    features = spark.createDataFrame([(i, 10 * j, 1.0 + j / 10) for i in range(12) for j in (1, 2)], "node long, fid long, v double")
    sizes = Counter(r.node for r in lookups.lookup_features(nodes(spark, 10, 11, 12, 13), features).collect())
    assert sizes == {10: 2, 11: 2, 12: 1, 13: 1}
    assert lookups.lookup_features(nodes(spark, 12), features).first()[:] == (12, 0, 0.0)
    with pytest.raises(Exception, match="no features of item 12"):
        lookups.lookup_items(nodes(spark, 12), features).collect()
    assert lookups.lookup_context(nodes(spark, 0, 0, 99), ring).count() == 6
    assert lookups.lookup_degrees(nodes(spark, 99), graph.degrees(ring)).first()[:] == (99, 0, 0)
    weights = spark.createDataFrame([(10, [1.0, 2.0])], "id long, vec array<double>")
    sums = lookups.embedding_lookup(features.withColumnRenamed("node", "row"), weights, 2).filter("row = 0").first()
    assert [round(x, 6) for x in sums.vec] == [1.1, 2.2]
    average = {r.fid: r.avg for r in neighbors.average_features(ring, features).filter("node = 1").collect()}  # 0, 12, 11
    assert {k: round(v, 6) for k, v in average.items()} == {0: 0.0, 10: round(2.2 / 3, 6), 20: round(2.4 / 3, 6)}


def test_swing(spark):
    users = {0: [5, 6, 7, 8, 9], 1: [5, 7, 8, 9], 2: [5, 9, 10, 11], 3: [5, 11], 4: [5, 11, 12, 13]}
    contexts = spark.createDataFrame([(u, i) for u, items in users.items() for i in items], "user long, item long")
    got = {r.j: r.score for r in neighbors.swing(contexts).filter("i = 5").collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {7: 0.0722, 8: 0.0722, 9: 0.3832, 11: 0.744}
    assert neighbors.swing(contexts, threshold=2).count() <= neighbors.swing(contexts).count()


def swing_by_hand(rows, alpha):
    items, users, scores = {}, {}, {}
    for u, i in set(rows):
        if u is not None and i is not None:
            items.setdefault(u, set()).add(i)
            users.setdefault(i, set()).add(u)
    for i, among in users.items():
        for u, v in itertools.combinations(sorted(among), 2):
            common = (items[u] & items[v]) - {i}
            for j in common:
                part = 1 / math.sqrt(len(items[u]) - 1) / math.sqrt(len(items[v]) - 1) / (alpha + len(common))
                scores[i, j] = scores.get((i, j), 0) + part
    return scores


@pytest.mark.parametrize("longest", [1 << 22, 7])
def test_swing_by_hand(spark, monkeypatch, longest):
    monkeypatch.setattr(neighbors, "LONGEST", longest)
    rng = random.Random(1)
    rows = [((1 << 63) - 1 - u if u % 9 == 0 else u - 20, rng.randrange(25) ** 2 - 50) for u in range(60) for _ in range(rng.randrange(9))]
    rows += [(u - 20, 10**12) for u in range(60)] + [(5, i) for i in range(-50, 200)] + [(None, 1), (None, 10**12), (3, None), (4, None)]  # an item of all, a user of many
    contexts = spark.createDataFrame(rows + rows[:50], "user long, item long")
    found = neighbors.swing(contexts, 0.5).collect()
    got, want = {(r.i, r.j): r.score for r in found}, swing_by_hand(rows, 0.5)
    assert len(found) == len(got) and got.keys() == want.keys() and len(want) > 300
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_swing_does_not_shuffle_pairs(spark):
    rows = [(u, i) for u in range(400) for i in (0, 1000 + u)] + [(0, 1001)]  # 79,800 pairs share item 0, one of them another item too
    df = neighbors.swing(spark.createDataFrame(rows, "user long, item long"))
    sc = spark.sparkContext
    before = sc._jsc.sc().statusStore()

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = before.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    old = written()
    assert {(r.i, r.j) for r in df.collect()} == {(0, 1001), (1001, 0)}
    assert 0 < sum(n for k, n in written().items() if k not in old) < 10000


def test_caches(ring):
    degrees = graph.degrees(ring)
    assert [r.node for r in neighbors.top_by_degree(degrees, 0.5).collect()] == list(range(6))
    assert neighbors.important(degrees, 0.5).count() == 13 and neighbors.random_share(degrees, 1.0, 1).count() == 13
    with pytest.raises(ValueError):
        neighbors.important(degrees, -1.0)
    assert [r.node for r in neighbors.page(degrees.select("node"), 2, 3).collect()] == [2, 3, 4]


def test_distributions(spark):
    freq = spark.createDataFrame([(0, 1), (1, 4), (2, 2), (3, 6), (4, 3), (5, 8), (6, 7), (7, 5), (8, 9)], "node long, freq long")
    total = sum(f**0.75 for f in range(1, 10))
    dist = sampling.negative_distribution(freq).cache()
    assert all(math.isclose(r.prob, r.freq**0.75 / total) for r in dist.join(freq, "node").collect())
    table = sampling.negative_distribution(freq, sampling.WORD2VEC)
    assert round(table.agg(F.sum("prob")).first()[0], 9) == 1
    draws = 40_000
    requests = spark.range(draws).select(F.lit(0).alias("ns"), "id")
    from tessella.functions.rng import uniform

    counts = {r.drawn: r.n for r in sampling.draw(requests, dist, uniform(3, "id")).groupBy("drawn").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == draws
    assert sum(not sampling.within_interval(counts[r.node], draws, r.prob) for r in dist.collect()) <= 1
    excluded = freq.filter("node > 2").select("node")
    out = sampling.shared_negatives(freq, dist, excluded, 50, 1)
    assert out.count() == 50 and {r.drawn for r in out.collect()} <= {0, 1, 2}
    assert sampling.independent_negatives(freq, dist, excluded, 5, 1).count() == 45
    with pytest.raises(Exception, match="all nodes are excluded"):
        sampling.shared_negatives(freq, dist, freq.select("node"), 5, 1).collect()


def test_neighbors_and_walks(spark, ring):
    every = sampling.sample_neighbors(nodes(spark, 0, 9), ring, -1, 1)
    assert sorted(r.nbr for r in every.filter("node = 0").collect()) == [10, 11, 12]
    for weighted in (False, True):
        some = Counter(r.node for r in sampling.sample_neighbors(nodes(spark, 0, 9), ring, 2, 1, weighted).distinct().collect())
        assert some == {0: 2, 9: 2}
        again = sampling.sample_neighbors(nodes(spark, 0), ring, 8, 1, weighted).collect()
        assert len(again) == 8 and {r.nbr for r in again} <= {10, 11, 12}
    out = walks.random_walks(nodes(spark, 0, 9), ring, 6, 1, epochs=2)
    edges = {(r.src, r.dst) for r in ring.collect()}
    for r in walks.sequences(out).collect():
        assert len(r.nodes) == 7 and all(e in edges for e in zip(r.nodes, r.nodes[1:]))
    assert walks.walk_edges(out).count() == 24
    assert walks.sequences(walks.random_walks(nodes(spark, 0, 9), ring, 3, 1, meta_path=[0, 1])).count() == 0
    short = walks.sequences(walks.random_walks(nodes(spark, 0, 9), ring, 3, 1, meta_path=[0, 0, 1])).collect()
    assert [len(r.nodes) for r in short] == [2, 2]
    dead = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, w double")
    assert walks.random_walks(nodes(spark, 1), dead, 5, 1).count() == 2


def test_subgraphs(spark, ring):
    levels, links = subgraphs.sample_levels(nodes(spark, 3, 3), ring, [3], 1)
    assert Counter(r.level for r in levels.collect()) == {0: 1, 1: 3}
    cells = subgraphs.blocks(levels, links, 1).collect()
    assert Counter(r.kind for r in cells) == {"self": 1, "neigh": 3} and {r.row for r in cells} == {0}
    assert sorted(r.col for r in cells if r.kind == "neigh") == [1, 2, 3]
    for p, least, most in ((0.0, 3, 3), (1.0, 0, 0)):
        assert least <= subgraphs.drop_edges(links, p, 1).count() <= most


def test_pairs(spark, ring):
    seqs = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [])], "key long, nodes array<long>")
    got = pairs.context_pairs(seqs, "key", "nodes", 1, 2).orderBy("i", "j").collect()
    assert [(r.center, r.context) for r in got] == [(1, 2), (1, 3), (2, 1), (2, 3), (2, 4), (3, 2), (3, 4), (4, 3)]
    dist = sampling.negative_distribution(graph.node_frequency(ring))
    out = pairs.pairs_with_negatives(pairs.context_pairs(seqs, "key", "nodes", 1, 1), dist, 3, 1)
    assert Counter(r.y for r in out.collect()) == {1: 6, 0: 18}
    with pytest.raises(Exception, match="labels of 1"):
        pairs.label_matrix(spark.createDataFrame([(1, [1, 5])], "node long, labels array<int>"), 2, 1).collect()


def test_tensors(spark):
    offsets, cols = [0, 3, 7, 9], [0, 1, 3, 2, 3, 4, 6, 1, 5]
    x = spark.createDataFrame([(r, c, 1.0) for r in range(3) for c in cols[offsets[r] : offsets[r + 1]]], "row long, col long, x double")
    w = [[1, 1], [1, 2], [2, 3], [1, 3], [5, 6], [3, 4], [4, 6]]
    w = spark.createDataFrame([(i, [float(v) for v in vec]) for i, vec in enumerate(w)], "id long, vec array<double>")
    assert {r.row: r.vec for r in tensors.mean_aggregate(x, w, 2).collect()} == {0: [1, 2], 1: [3, 4.5], 2: [2, 3]}
    assert {r.row: r.vec for r in tensors.sum_aggregate(x, w, 2).collect()} == {0: [3, 6], 1: [12, 18], 2: [4, 6]}
    logits = spark.createDataFrame([(r, k, float(v)) for r, vs in enumerate([[1, 2, 3], [6, 5, 4, 7], [8, 9]]) for k, v in enumerate(vs)], "row long, k int, x double")
    got = [round(r.p, 5) for r in tensors.edge_softmax(logits).orderBy("row", "k").collect()]
    assert got == [0.09003, 0.24473, 0.66524, 0.23688, 0.08714, 0.03206, 0.64391, 0.26894, 0.73106]
    v = spark.createDataFrame([(i, [3.0 * i, 3.0 * i + 1, 3.0 * i + 2]) for i in range(5)], "id long, vec array<double>")
    ab = spark.createDataFrame([(0, 1), (1, 3), (2, 2), (3, 4)], "a long, b long")
    assert [r.z for r in tensors.batch_dot(ab, v, v).orderBy("a").collect()] == [14, 122, 149, 392]
    ones = spark.createDataFrame([(1, [1.0, 1.0], [1.0] * 4)], "row long, weights array<double>, vec array<double>")
    assert tensors.weighted_average(ones, 2, 2).first().vec == [1, 1]


def test_metrics(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "id long, vec array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "q long, vec array<double>")
    top = [(r.q, r.item) for r in metrics.top_inner_products(queries, items, 1).orderBy("q").collect()]
    assert top == [(7, 1), (8, 2)]
    own = spark.createDataFrame([(7, 3), (8, 2), (8, 99)], "q long, item long")
    assert metrics.hit_rate(queries, items, own, 1).first()[:] == (1, 1, 2, 0.5)
    rows = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "score double, y int")
    assert metrics.auc(rows).first().auc == 0.875
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1)], "node long, label string, score double")
    truth = spark.createDataFrame([(1, "a")], "node long, label string")
    assert metrics.f1(metrics.top_k_labels(scores, truth)).first().micro_f1 == 1


def test_text(spark, tmp_path):
    lines = ["0 12:1.1 11:1.2", "1 5:11", "2 x:1", "3", "18446744073709551615 1:-10", "4 5:1 6"]
    (tmp_path / "adj").mkdir()
    (tmp_path / "adj" / "a").write_text("\n".join(lines))
    adj = text.read_adjacency(spark, f"{tmp_path}/adj").cache()
    assert {r.node: len(r.pairs) for r in adj.collect()} == {0: 2, -1: 1}
    text.write_lines(text.format_pairs(adj), f"{tmp_path}/out")
    assert sorted(map(str, text.read_adjacency(spark, f"{tmp_path}/out").collect())) == sorted(map(str, adj.collect()))
    (tmp_path / "plain").write_text("1 2 1.1\n2 4\n5 6 99\nx 1\n7 8 9 x\n")
    assert [(r.src, r.dst, round(r.w, 3)) for r in text.read_edges(spark, f"{tmp_path}/plain").collect()] == [(1, 2, 1.1), (2, 4, 1.0), (7, 8, 9.0)]
    assert [r.nodes for r in text.read_sequences(spark, f"{tmp_path}/plain").collect()] == [[1, 2], [2, 4], [5, 6, 99], [7, 8, 9]]
    assert [r.weight for r in text.read_nodes(spark, f"{tmp_path}/plain").filter("node = 2").collect()] == [4.0]
    (tmp_path / "ns").write_text("user 0\n# no\nitem 1\n")
    names = text.read_namespaces(spark, f"{tmp_path}/ns")
    assert {(r.name, r.ns_id) for r in names.collect()} == {("user", 0), ("item", 1)}
    (tmp_path / "labels").write_text("1 0\n2 0 1\n3\n4 a\n")
    assert {r.node: r.labels for r in text.read_labels(spark, f"{tmp_path}/labels").collect()} == {1: [0], 2: [0, 1]}
    (tmp_path / "params").write_text("W 1 5 0.1,0.2\nb 0 1,2\n")
    assert [(r.tensor, r.id, len(r.vec)) for r in text.read_parameters(spark, f"{tmp_path}/params").collect()] == [("W", 5, 2), ("b", None, 2)]
    assert text.parse_meta_paths("1:2:3,1:4") == [[1, 2, 3], [1, 4]] and text.parse_groups("1:5:4") == [(1, 5, 4)]


def test_clients(spark, ring):
    client = GraphClient(ring, seed=1)
    none = nodes(spark, 99)
    assert client.shared_sample_negative(10, nodes(spark, 1, 3), none).count() == 10
    assert client.indep_sample_negative(10, nodes(spark, 1, 3), none).count() == 20
    assert client.static_traverse(nodes(spark, 0), 3).count() == 4
    assert client.random_sample_neighbor(2, nodes(spark, 0)).count() == 2 and client.lookup_context(nodes(spark, 0)).count() == 3
    deep = DeepClient(graph.node_frequency(ring), instances=graph.dense_index(graph.node_frequency(ring)))
    assert deep.sample_instance(20).count() == 20


def test_parameters(spark, tmp_path):
    schema = "id long, vec array<float>, ts long"
    first, second = [(1, [1.0], 10), (2, [2.0], 10), (2, [3.0], 11)], [(2, [4.0], 20), (3, [5.0], 20)]
    store = ParameterTable(spark, f"{tmp_path}/params")
    for k in (0, 1, 1):  # a batch may come again
        store.apply(spark.createDataFrame((first, second)[k], schema), k)
    assert {r.id: r.vec for r in store.read(1).collect()} == {1: [1.0], 2: [4.0], 3: [5.0]}
    assert {r.id for r in expire(store.read(1), 20, 5).collect()} == {2, 3}
    assert newest(spark.createDataFrame(first, schema)).count() == 2
    assert warm_start(store.read(0), store.read(1)).filter("id = 2").first().vec == [3.0]
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1,), (1,), (2,)], "id long").write.mode("overwrite").parquet(f"{tmp_path}/in")
    ids = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    query = stream_counts(ids).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert [r.id for r in admit(spark.table("counts"), 2).collect()] == [1]


def test_top_inner_products_in_blocks(spark, monkeypatch):
    """The same as by comparing all pairs, for odd vectors and copies too, without a join of all pairs."""
    for name, size in (("QUERY_BLOCK", 5), ("ITEM_BLOCK", 9), ("PAIRS", 20)):
        monkeypatch.setattr(metrics, name, size)
    nan, inf, rng = float("nan"), float("inf"), random.Random(3)
    vectors = [None, [1.0, None], [1.0], [], [nan, 1.0], [inf, 0.0], [-1e200, 1e200], *[[0.1, 0.2]] * 12]
    vectors += [[rng.uniform(-1, 1), rng.uniform(-1, 1)] for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, vec array<double>")
    score = lambda q, x: F.aggregate(F.zip_with(q, x, lambda a, b: a * b), F.lit(0.0), lambda t, z: t + z)
    pairs = rows.toDF("item", "x").crossJoin(rows.toDF("q", "v")).select("q", "item", score(F.col("v"), F.col("x")).alias("score"))
    for k in (1, 3, 45):
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item"))
        plain = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
        top = metrics.top_inner_products(rows, rows, k)
        assert sorted(map(repr, top.collect())) == sorted(map(repr, plain.collect()))
        assert "NestedLoop" not in top._jdf.queryExecution().toString()
    assert metrics.top_inner_products(rows, rows.limit(0), 3).count() == 0


def test_lines_are_split_once(spark):
    """Filters on what is parsed do not split, or convert, again."""
    rows = spark.createDataFrame([(v,) for v in ("1 2 3", " 18446744073709551615   9223372036854775808 ", "18446744073709551616 1", "1", "", "1 2 11", "1 x", None)], "value string")
    edges = text.parse_edges(rows)
    assert sorted(map(tuple, edges.collect())) == [(-1, -(1 << 63), 1.0), (1, 2, 3.0)]
    for parsed in (edges, text.parse_adjacency(rows), text.parse_labels(rows), text.parse_labelled_edges(rows), text.parse_nodes(rows), text.parse_sequences(rows)):
        assert parsed._jdf.queryExecution().optimizedPlan().toString().count("split(trim(") == 1


def test_walk_of_steps_made_once(spark):
    """Dead ends and long walks keep their rows; each step's join is in the plan once, and none numbers neighbors for degrees."""
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)] + [(20, 21, 2.0)], "src long, dst long, w double")
    for weighted in (False, True):
        out = walks.random_walks(nodes(spark, 0, 0, 8, 20, 99), edges, 11, 1, weighted=weighted, epochs=2)
        want = [(s, e, k, s + k) for e in (0, 1) for s, last in ((0, 11), (8, 4), (20, 1), (99, 0)) for k in range(last + 1)]
        assert sorted(map(tuple, out.collect())) == sorted(want)
        plan = walks.random_walks(nodes(spark, 0), edges, 3, 1, weighted=weighted)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [row_number") == 3


def test_feature_average_in_finer_parts(spark):
    """The joined rows and the sums are dealt into more parts than Spark's shuffles."""
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 2)], "src long, dst long")
    features = spark.createDataFrame([(2, 7, 0.5), (2, 8, 1.0)], "node long, fid long, v double")
    out = neighbors.average_features(edges, features)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0.0), (1, 7, 0.25), (1, 8, 0.5), (4, 7, 0.5), (4, 8, 1.0)]
    parts = neighbors.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count(f", {parts}") == 2
