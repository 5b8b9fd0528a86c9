"""The library's queries over the tables of a folder, each with SQL that gives the same rows.

The graph: customers (type 1) and the parts (type 2) that they ordered, in both directions, weighted by lines up to 10.
Parts of size over 5 have two features; other nodes have none. Sequences are users' event types in order of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ids import encode_id, parameter_shard_of, shard_of, sub_of, type_of
from tessella.functions.rng import uniform
from tessella.functions.vectors import dot, l2_normalize
from tessella.operators import graph, lookups, metrics, neighbors, pairs, sampling, subgraphs, tensors, walks
from tessella.plans import embeddings, instances, objectives
from tessella.sources import datasets, text
from tessella.streaming import parameters

SEED = 7
DIM = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cp = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
    ends = cp.select(
        encode_id(F.lit(1), F.col("o_custkey")).alias("u"), encode_id(F.lit(2), F.col("l_partkey")).alias("i"), F.least("n", F.lit(10)).cast("double").alias("w")
    )
    return ends.select(F.inline(F.array(
        F.struct(F.col("u").alias("src"), F.col("i").alias("dst"), "w"), F.struct(F.col("i").alias("src"), F.col("u").alias("dst"), "w")
    )))


def directed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three types: customers to the parts of their odd orders, parts to the customers of even ones, parts to suppliers, weighted by lines up to 10"""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    c, p = encode_id(F.lit(1), F.col("o_custkey")), encode_id(F.lit(2), F.col("l_partkey"))
    odd = F.col("o_orderkey") % 2 == 1
    ends = F.array(F.struct(F.when(odd, c).otherwise(p).alias("src"), F.when(odd, p).otherwise(c).alias("dst")), F.struct(p.alias("src"), encode_id(F.lit(3), F.col("l_suppkey")).alias("dst")))
    return met.select(F.inline(ends)).groupBy("src", "dst").agg(F.least(F.count("*"), F.lit(10)).cast("double").alias("w"))


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").filter("p_size > 5")
    node = encode_id(F.lit(2), F.col("p_partkey"))
    both = F.array(
        F.struct(encode_id(F.lit(3), F.col("p_size")).alias("fid"), F.lit(1.0).alias("v")),
        F.struct(encode_id(F.lit(4), F.col("p_partkey") % 25).alias("fid"), (F.col("p_retailprice") / 1000).alias("v")),
    )
    return part.select(node.alias("node"), F.inline(both))


def users_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(encode_id(F.lit(1), F.col("c_custkey")).alias("node"))


def parts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(encode_id(F.lit(2), F.col("p_partkey")).alias("node"))


def frequencies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("freq"))
    return lines.select(encode_id(F.lit(2), F.col("l_partkey")).alias("node"), "freq")


def sequences_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = F.sort_array(F.collect_list(F.struct("ts", "event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(events, lambda e: e["event_id"]).alias("nodes"))


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


T1, T2, T3, T4 = (f"{t << 48}" for t in (1, 2, 3, 4))
CP = "cp AS (SELECT o_custkey AS c, l_partkey AS p, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
E = CP + f""", e AS (SELECT {T1} + c AS src, {T2} + p AS dst, CAST(least(n, 10) AS DOUBLE) AS w FROM cp
UNION ALL SELECT {T2} + p, {T1} + c, CAST(least(n, 10) AS DOUBLE) FROM cp)"""
DIRECTED = f"""m AS (SELECT {T1} + o_custkey AS c, {T2} + l_partkey AS p, {T3} + l_suppkey AS s, o_orderkey % 2 = 1 AS odd FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS (SELECT src, dst, CAST(least(count(*), 10) AS DOUBLE) AS w FROM (SELECT CASE WHEN odd THEN c ELSE p END AS src, CASE WHEN odd THEN p ELSE c END AS dst FROM m UNION ALL SELECT p, s FROM m) GROUP BY src, dst)"""
R = E + ", r AS (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS deg FROM e)"
FEATURES = f"""f AS (SELECT {T2} + p_partkey AS node, {T3} + p_size AS fid, CAST(1 AS DOUBLE) AS v FROM part WHERE p_size > 5
UNION ALL SELECT {T2} + p_partkey, {T4} + p_partkey % 25, p_retailprice / 1000 FROM part WHERE p_size > 5)"""
FREQ = f"fr AS (SELECT {T2} + l_partkey AS node, count(*) AS freq FROM lineitem GROUP BY 1)"
NODE_FREQ = E + ", nf AS (SELECT node, CAST(count(*) AS BIGINT) AS freq FROM (SELECT dst AS node FROM e UNION ALL SELECT DISTINCT src FROM e) GROUP BY node)"
DIST = FREQ + ", d AS (SELECT CAST(node >> 48 AS INTEGER) AS ns, node, pow(freq, 0.75) / sum(pow(freq, 0.75)) OVER (PARTITION BY node >> 48) AS prob FROM fr)"
CUM = DIST + """, c0 AS (SELECT ns, node, prob, sum(prob) OVER (PARTITION BY ns ORDER BY node ROWS UNBOUNDED PRECEDING) AS hi FROM d),
cu AS (SELECT ns, node, hi - prob AS lo, CASE WHEN lead(node) OVER (PARTITION BY ns ORDER BY node) IS NULL THEN 1.0 ELSE hi END AS hi FROM c0)"""
SEQ = """s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""


def u(*keys: str, seed: int = SEED) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"SELECT {T1} + c_custkey AS node, CAST(1 AS INTEGER) AS type, c_custkey AS sub, CAST(({T1} + c_custkey) % 7 AS INTEGER) AS shard, CAST(({T1} + c_custkey) % 9973 % 7 AS INTEGER) AS param_shard FROM customer")
def ids(spark, sf_dir):
    node = F.col("node")
    return users_of(spark, sf_dir).select("node", type_of(node).alias("type"), sub_of(node).alias("sub"), shard_of(node, 7).alias("shard"), parameter_shard_of(node, 7).alias("param_shard"))


@query(f"WITH {E}, t AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node) SELECT * FROM t")
def degrees(spark, sf_dir):
    return graph.degrees(edges_of(spark, sf_dir))


@query(f"WITH {E} SELECT src AS node, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS place, unnest(l) AS dst FROM (SELECT src, list(dst ORDER BY dst) AS l FROM e GROUP BY src)")
def adjacency(spark, sf_dir):
    adj = graph.adjacency(edges_of(spark, sf_dir))
    rows = adj.select("node", F.posexplode("pairs").alias("place", "pair"))
    return rows.select("node", (F.col("place") + 1).alias("place"), F.col("pair.id").alias("dst"))


@query(f"WITH {NODE_FREQ} SELECT * FROM nf")
def node_frequency(spark, sf_dir):
    return graph.node_frequency(edges_of(spark, sf_dir))


@query(f"WITH {NODE_FREQ} SELECT CAST(node >> 48 AS INTEGER) AS ns, count(*) AS nodes, CAST(sum(freq) AS BIGINT) AS freq FROM nf GROUP BY 1")
def namespace_totals(spark, sf_dir):
    return graph.namespace_totals(graph.node_frequency(edges_of(spark, sf_dir)))


@query(f"WITH {NODE_FREQ}, t AS (SELECT CAST(node >> 48 AS INTEGER) AS ns, CAST(node % 4 AS INTEGER) AS shard, CAST(sum(freq) AS BIGINT) AS freq FROM nf GROUP BY 1, 2) SELECT ns, shard, freq, round(freq / sum(freq) OVER (PARTITION BY ns), 6) AS prob FROM t")
def shard_distribution(spark, sf_dir):
    return rounded(graph.shard_distribution(graph.node_frequency(edges_of(spark, sf_dir)), 4), "prob")


@query(f"WITH {NODE_FREQ} SELECT node, CAST(node >> 48 AS INTEGER) AS ns, row_number() OVER (PARTITION BY node >> 48 ORDER BY node) - 1 AS idx, row_number() OVER (ORDER BY node) - 1 AS global_idx FROM nf")
def namespace_index(spark, sf_dir):
    return graph.namespace_index(graph.node_frequency(edges_of(spark, sf_dir)))


@query(f"WITH {E} SELECT {T1} + c_custkey AS node, dst, w FROM customer JOIN e ON src = {T1} + c_custkey")
def context_lookup(spark, sf_dir):
    return lookups.lookup_context(users_of(spark, sf_dir), edges_of(spark, sf_dir))


@query(f"WITH {FEATURES} SELECT {T2} + p_partkey AS node, coalesce(fid, 0) AS fid, coalesce(v, 0.0) AS v FROM part LEFT JOIN f ON node = {T2} + p_partkey")
def node_feature_lookup(spark, sf_dir):
    return lookups.lookup_features(parts_of(spark, sf_dir), features_of(spark, sf_dir))


@query(f"WITH {FEATURES} SELECT node, fid, v FROM f JOIN (SELECT {T2} + p_partkey AS k FROM part WHERE p_size > 5) ON node = k")
def item_feature_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "part").filter("p_size > 5").select(encode_id(F.lit(2), F.col("p_partkey")).alias("node"))
    return lookups.lookup_items(items, features_of(spark, sf_dir))


@query(f"""WITH {DIRECTED}, t AS (SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node)
SELECT {T1} + c_custkey AS node, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree FROM customer LEFT JOIN t ON node = {T1} + c_custkey""")
def degree_lookup(spark, sf_dir):
    out = lookups.lookup_degrees(users_of(spark, sf_dir), graph.degrees(directed_of(spark, sf_dir)))
    return out.select("node", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))


AVERAGE = """, x AS (SELECT src, coalesce(fid, 0) AS fid, coalesce(v, 0.0) AS v FROM {edges} LEFT JOIN f ON f.node = dst), n AS (SELECT src, count(*) AS n FROM {edges} GROUP BY src)
SELECT x.src AS node, fid, round(sum(v) / any_value(n), 12) AS avg FROM x JOIN n ON n.src = x.src GROUP BY x.src, fid"""


@query(f"WITH {E}, {FEATURES}" + AVERAGE.format(edges="e"))
def neighbor_feature_average(spark, sf_dir):
    return rounded(neighbors.average_features(edges_of(spark, sf_dir), features_of(spark, sf_dir)), "avg", digits=12)


SAMPLED = f"""a AS (SELECT src, dst FROM r WHERE deg <= 20 UNION ALL SELECT q.src, r.dst FROM (SELECT src, CAST(floor({u('src', 'draw')} * deg) AS BIGINT) AS k
FROM (SELECT src, deg, unnest(range(0, 20)) AS draw FROM r WHERE k = 0 AND deg > 20)) q JOIN r ON r.src = q.src AND r.k = q.k)"""


@query(f"WITH {R}, {SAMPLED}, {FEATURES}" + AVERAGE.format(edges="a"))
def neighbor_feature_average_sampled(spark, sf_dir):
    return rounded(neighbors.average_features_sampled(edges_of(spark, sf_dir), features_of(spark, sf_dir), 20, SEED), "avg", digits=12)


@query(f"""WITH {CP}, s AS (SELECT c, count(*) AS n FROM cp GROUP BY c), us AS (SELECT cp.c, p, s.n FROM cp JOIN s ON s.c = cp.c WHERE s.n > 1),
pr AS (SELECT a.p AS i, a.c AS u, b.c AS v, a.n AS n_a, b.n AS n_b FROM us a JOIN us b ON a.p = b.p AND a.c < b.c),
sh AS (SELECT i, u, v, n_a, n_b, x.p AS j FROM pr JOIN cp x ON x.c = u JOIN cp y ON y.c = v AND y.p = x.p WHERE x.p <> i),
cm AS (SELECT i, u, v, count(*) AS m FROM sh GROUP BY i, u, v)
SELECT {T2} + sh.i AS i, {T2} + j AS j, round(sum(1 / (sqrt(n_a - 1.0) * sqrt(n_b - 1.0) * (1.0 + m))), 6) AS score FROM sh JOIN cm ON cm.i = sh.i AND cm.u = sh.u AND cm.v = sh.v GROUP BY 1, 2""")
def swing(spark, sf_dir):
    users = edges_of(spark, sf_dir).filter(type_of(F.col("src")) == 1)
    return rounded(neighbors.swing(users.select(F.col("src").alias("user"), F.col("dst").alias("item"))), "score")


DEGREES = "dg AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY src)"


@query(f"WITH {E}, {DEGREES} SELECT node, out_degree FROM dg ORDER BY out_degree DESC, node LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM dg)")
def degree_cache(spark, sf_dir):
    return neighbors.top_by_degree(graph.degrees(edges_of(spark, sf_dir)), 0.1).select("node", F.col("out_degree").cast("long").alias("out_degree"))


@query(f"""WITH {DIRECTED}, t AS (SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node)
SELECT node FROM t WHERE o > 0 AND (i + 1) / (o + 1) > 0.5""")
def importance_cache(spark, sf_dir):
    return neighbors.important(graph.degrees(directed_of(spark, sf_dir)), 0.5).select("node")


@query(f"SELECT {T1} + c_custkey AS node FROM customer WHERE {u(f'{T1} + c_custkey')} < 0.3")
def random_cache(spark, sf_dir):
    return neighbors.random_share(users_of(spark, sf_dir), 0.3, SEED)


@query(f"SELECT {T1} + c_custkey AS node FROM customer ORDER BY 1 LIMIT 50 OFFSET 20")
def cache_page(spark, sf_dir):
    return neighbors.page(users_of(spark, sf_dir), 20, 50)


@query(f"WITH {E} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS prob FROM e")
def neighbor_probability(spark, sf_dir):
    return rounded(graph.neighbor_probability(edges_of(spark, sf_dir)), "prob")


@query(f"WITH {DIST} SELECT ns, node, round(prob, 9) AS prob FROM d")
def negative_distribution(spark, sf_dir):
    return rounded(sampling.negative_distribution(frequencies_of(spark, sf_dir)), "prob", digits=9)


@query(f"WITH {FREQ} SELECT CAST(node >> 48 AS INTEGER) AS ns, node, round(1.0 / count(*) OVER (PARTITION BY node >> 48), 9) AS prob FROM fr")
def negative_distribution_uniform(spark, sf_dir):
    return rounded(sampling.negative_distribution(frequencies_of(spark, sf_dir), sampling.UNIFORM), "prob", digits=9)


@query(f"""WITH {DIST}, p AS (SELECT ns, node, pow(prob, 0.75) AS p, count(*) OVER (PARTITION BY ns) AS n FROM d),
sh AS (SELECT ns, node, p, n, sum(p) OVER (PARTITION BY ns ORDER BY p DESC, node ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY ns) AS s FROM p),
en AS (SELECT ns, node, p, n, least(ceil(s * n * 10 - 1e-9), n * 10) AS en FROM sh)
SELECT ns, node, round((en - coalesce(lag(en) OVER (PARTITION BY ns ORDER BY p DESC, node), 0)) / (n * 10), 6) AS prob FROM en""")
def negative_distribution_word2vec(spark, sf_dir):
    return rounded(sampling.negative_distribution(frequencies_of(spark, sf_dir), sampling.WORD2VEC), "prob")


@query(f"WITH {CUM} SELECT ns, node, round(lo, 6) AS lo, round(c0.hi, 6) AS hi FROM cu JOIN c0 USING (ns, node)")
def cumulative_distribution(spark, sf_dir):
    return rounded(sampling.cumulative(sampling.negative_distribution(frequencies_of(spark, sf_dir))), "lo", "hi")


NO_SMALL = f"(SELECT {T2} + p_partkey FROM part WHERE p_size <= 5)"
REST = DIST.replace(", d AS", ", d0 AS") + f""", d AS (SELECT ns, node, prob / sum(prob) OVER (PARTITION BY ns) AS prob FROM d0 WHERE node NOT IN {NO_SMALL}),
c0 AS (SELECT ns, node, prob, sum(prob) OVER (PARTITION BY ns ORDER BY node ROWS UNBOUNDED PRECEDING) AS hi FROM d),
cu AS (SELECT ns, node, hi - prob AS lo, CASE WHEN lead(node) OVER (PARTITION BY ns ORDER BY node) IS NULL THEN 1.0 ELSE hi END AS hi FROM c0)"""


def _small(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size <= 5").select(encode_id(F.lit(2), F.col("p_partkey")).alias("node"))


@query(f"WITH {REST}, q AS (SELECT CAST(2 AS INTEGER) AS ns, CAST(unnest(range(0, 500)) AS INTEGER) AS draw) SELECT q.ns, q.draw, node AS drawn FROM q JOIN cu ON cu.ns = q.ns AND {u('q.ns', 'q.draw')} >= lo AND {u('q.ns', 'q.draw')} < hi")
def shared_negatives(spark, sf_dir):
    return sampling.shared_negatives(parts_of(spark, sf_dir), sampling.negative_distribution(frequencies_of(spark, sf_dir)), _small(spark, sf_dir), 500, SEED)


@query(f"WITH {REST}, q AS (SELECT {T2} + p_partkey AS node, CAST(2 AS INTEGER) AS ns, CAST(unnest(range(0, 5)) AS INTEGER) AS draw FROM part), z AS (SELECT *, {u('node', 'ns', 'draw')} AS u FROM q) SELECT z.node, z.ns, z.draw, cu.node AS drawn FROM z JOIN cu ON cu.ns = z.ns AND u >= lo AND u < hi")
def indep_negatives(spark, sf_dir):
    return sampling.independent_negatives(parts_of(spark, sf_dir), sampling.negative_distribution(frequencies_of(spark, sf_dir)), _small(spark, sf_dir), 5, SEED)


@query(f"WITH {R} SELECT src AS node, k AS draw, dst AS nbr FROM r")
def neighbor_sample_full(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    out = sampling.sample_neighbors(edges.select(F.col("src").alias("node")), edges, -1, SEED)
    return out.select("node", F.col("draw").cast("long").alias("draw"), "nbr")


SAMPLE = """picked AS (SELECT src AS node, CASE WHEN deg = {n} THEN k ELSE row_number() OVER (PARTITION BY src ORDER BY {key}, dst) - 1 END AS draw, dst AS nbr, deg FROM r),
again AS (SELECT q.src AS node, q.draw, r.dst AS nbr FROM (SELECT src, draw, CAST(floor({u} * deg) AS BIGINT) AS k FROM (SELECT src, deg, unnest(range(0, {n})) AS draw FROM r WHERE k = 0 AND deg < {n})) q JOIN r ON r.src = q.src AND r.k = q.k),
sm AS (SELECT node, draw, nbr FROM picked WHERE deg >= {n} AND draw < {n} UNION ALL SELECT node, draw, nbr FROM again)"""
KEY = f"-ln(greatest({u('src', 'dst')}, 1e-12))"


@query(f"WITH {R}, {SAMPLE.format(n=30, key=KEY + ' / 1.0', u=u('src', 'draw'))} SELECT node, CAST(draw AS BIGINT) AS draw, nbr FROM sm")
def neighbor_sample(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    out = sampling.sample_neighbors(edges.select(F.col("src").alias("node")), edges, 30, SEED)
    return out.select("node", F.col("draw").cast("long").alias("draw"), "nbr")


@query(f"WITH {R}, {SAMPLE.format(n=5, key=KEY + ' / w', u=u('src', 'draw'))} SELECT node, nbr FROM sm WHERE node IN (SELECT src FROM r WHERE deg >= 5)")
def neighbor_sample_weighted(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    rich = graph.degrees(edges).filter("out_degree >= 5").select("node")
    return sampling.sample_neighbors(rich, edges, 5, SEED, weighted=True).select("node", "nbr")


WALK = """walk(start, epoch, step, node) AS (SELECT {start} AS start, CAST(ep AS INTEGER), CAST(0 AS INTEGER), {start} FROM {source}
UNION ALL SELECT start, epoch, CAST(step + 1 AS INTEGER), r.dst FROM walk JOIN r ON r.src = walk.node AND {pick} WHERE step < {length})"""
UNIFORM_PICK = f"r.k = CAST(floor({u('start', 'epoch', 'step + 1')} * r.deg) AS BIGINT)"
STARTS = dict(start=f"({T1} + c_custkey)", source="customer, (SELECT unnest(range(0, 2)) AS ep)")


@query(f"WITH RECURSIVE {R}, {WALK.format(**STARTS, pick=UNIFORM_PICK, length=4)} SELECT * FROM walk")
def random_walk(spark, sf_dir):
    return walks.random_walks(users_of(spark, sf_dir), edges_of(spark, sf_dir), 4, SEED, epochs=2)


WEIGHTED = R + """, h AS (SELECT src, dst, k, deg, sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY src) AS share FROM r),
wr AS (SELECT src, dst, coalesce(lag(share) OVER (PARTITION BY src ORDER BY k), 0.0) AS lo, CASE WHEN k = deg - 1 THEN 1.0 ELSE share END AS hi FROM h)"""
U_STEP = u("start", "epoch", "step + 1")


@query(f"WITH RECURSIVE {WEIGHTED}, {WALK.format(**STARTS, pick=f'{U_STEP} >= r.lo AND {U_STEP} < r.hi', length=3).replace('JOIN r ON', 'JOIN wr r ON')} SELECT * FROM walk")
def random_walk_weighted(spark, sf_dir):
    return walks.random_walks(users_of(spark, sf_dir), edges_of(spark, sf_dir), 3, SEED, weighted=True, epochs=2)


def _typed_step(old: str, new: str, step: int, kind: int) -> str:
    ranked = f"(SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS deg FROM e WHERE dst >> 48 = {kind})"
    return f"{new} AS (SELECT start, epoch, CAST({step} AS INTEGER) AS step, r.dst AS node FROM {old} w JOIN {ranked} r ON r.src = w.node AND r.k = CAST(floor({u('start', 'epoch', str(step))} * r.deg) AS INTEGER))"


@query(f"""WITH {DIRECTED}, w0 AS (SELECT DISTINCT {T1} + c_custkey AS start, CAST(unnest(range(0, 2)) AS INTEGER) AS epoch, CAST(0 AS INTEGER) AS step, {T1} + c_custkey AS node FROM customer),
{_typed_step("w0", "w1", 1, 2)}, {_typed_step("w1", "w2", 2, 3)} SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2""")
def metapath_walk(spark, sf_dir):
    """Customers, parts and suppliers, in a graph whose parts also lead back to customers"""
    both = users_of(spark, sf_dir).union(parts_of(spark, sf_dir))
    return walks.random_walks(both, directed_of(spark, sf_dir), 2, SEED, epochs=2, meta_path=[1, 2, 3])


@query(f"WITH RECURSIVE {R}, {WALK.format(**STARTS, pick=UNIFORM_PICK, length=3)} SELECT start AS src, node AS dst FROM walk WHERE step > 0")
def walk_edges_dump(spark, sf_dir):
    return walks.walk_edges(walks.random_walks(users_of(spark, sf_dir), edges_of(spark, sf_dir), 3, SEED, epochs=2))


@query(f"WITH {SEQ} SELECT a.user_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, a.event_id AS center, b.event_id AS context FROM s a JOIN s b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 3 AND a.i + 2 AND a.i <> b.i")
def skipgram_context(spark, sf_dir):
    return pairs.context_pairs(sequences_of(spark, sf_dir), "user_id", "nodes", 3, 2)


@query(f"""WITH RECURSIVE {R}, {WALK.format(**STARTS, pick=UNIFORM_PICK, length=4)}
SELECT a.start, CASE WHEN a.node >> 48 = 1 THEN a.node ELSE b.node END AS src, CASE WHEN a.node >> 48 = 1 THEN b.node ELSE a.node END AS dst
FROM walk a JOIN walk b ON a.start = b.start AND a.epoch = b.epoch AND abs(a.step - b.step) BETWEEN 1 AND 2 AND a.node >> 48 <> b.node >> 48""")
def cross_type_pairs(spark, sf_dir):
    seqs = walks.sequences(walks.random_walks(users_of(spark, sf_dir), edges_of(spark, sf_dir), 4, SEED, epochs=2))
    return pairs.cross_type_pairs(seqs, "start", "nodes", 2, 1)


EDGES_TO_PARTS = f"SELECT src, dst FROM e WHERE src < {T2}"


@query(f"""WITH {E}, {CUM}, q AS (SELECT DISTINCT src, CAST(2 AS INTEGER) AS ns, unnest(range(0, 5)) AS draw FROM ({EDGES_TO_PARTS})),
t AS (SELECT *, unnest(range(0, 12)) AS k FROM q), z AS (SELECT *, {u('src', 'draw', 'k')} AS u FROM t),
d1 AS (SELECT z.src, z.draw, z.k, node FROM z JOIN cu ON cu.ns = z.ns AND u >= lo AND u < hi),
d2 AS (SELECT src, draw, arg_min(node, k) AS node FROM d1 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = d1.src AND e.dst = d1.node) GROUP BY src, draw)
SELECT src, dst, CAST(1 AS INTEGER) AS y FROM ({EDGES_TO_PARTS}) UNION ALL SELECT src, node, CAST(0 AS INTEGER) FROM d2""")
def edges_with_negatives(spark, sf_dir):
    edges = edges_of(spark, sf_dir).filter(type_of(F.col("src")) == 1)
    return pairs.edges_with_negatives(edges, sampling.negative_distribution(frequencies_of(spark, sf_dir)), 5, SEED)


@query(f"""WITH {CUM}, q AS (SELECT CAST(2 AS INTEGER) AS ns, unnest(range(0, 4)) AS draw), n AS (SELECT draw, node FROM q JOIN cu ON cu.ns = q.ns AND {u('q.ns', 'draw')} >= lo AND {u('q.ns', 'draw')} < hi)
SELECT o_orderkey AS "row", CAST(0 AS INTEGER) AS col, {T2} + l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1
UNION ALL SELECT o_orderkey, CAST(draw + 1 AS INTEGER), node FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1, n""")
def softmax_columns(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("row"), encode_id(F.lit(2), F.col("l_partkey")).alias("item"))
    return pairs.softmax_columns(first, sampling.negative_distribution(frequencies_of(spark, sf_dir)), 4, SEED)


@query(f"WITH x AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM labels), q AS (SELECT draw, CAST(floor({u('draw')} * (SELECT any_value(n) FROM x)) AS BIGINT) AS idx FROM (SELECT unnest(range(0, 200)) AS draw)) SELECT draw, x.idx, doc_id AS node, quality, toxic FROM q JOIN x ON x.idx = q.idx")
def instance_sample(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "node")
    rows = labels.join(graph.dense_index(labels), "node")
    return sampling.sample_instances(rows, "idx", labels.count(), 200, SEED).select("draw", "idx", "node", "quality", "toxic")


LEVELS = f"""{R}, l0 AS (SELECT DISTINCT {T1} + c_custkey AS node FROM customer), {SAMPLE.format(n=3, key=KEY + ' / 1.0', u=u('src', 'draw'))},
k0 AS (SELECT DISTINCT node, nbr FROM sm WHERE node IN (SELECT node FROM l0)), l1 AS (SELECT DISTINCT nbr AS node FROM k0),
{SAMPLE.format(n=2, key=KEY.replace("'7'", "'8'") + ' / 1.0', u=u('src', 'draw', seed=SEED + 1)).replace('picked', 'picked1').replace('again', 'again1').replace('sm AS', 'sm1 AS')},
k1 AS (SELECT DISTINCT node, nbr FROM sm1 WHERE node IN (SELECT node FROM l1))"""


@query(f"WITH {LEVELS} SELECT CAST(0 AS INTEGER) AS level, node FROM l0 UNION ALL SELECT CAST(1 AS INTEGER), node FROM l1 UNION ALL SELECT DISTINCT CAST(2 AS INTEGER), nbr FROM k1")
def subgraph_levels(spark, sf_dir):
    return subgraphs.sample_levels(users_of(spark, sf_dir), edges_of(spark, sf_dir), [3, 2], SEED)[0]


@query(f"""WITH {LEVELS}, l2 AS (SELECT DISTINCT nbr AS node FROM k1), al AS (SELECT 0 AS level, node FROM l0 UNION ALL SELECT 1, node FROM l1 UNION ALL SELECT 2, node FROM l2),
ix AS (SELECT level, node, row_number() OVER (ORDER BY level, node) - 1 AS idx FROM al), lk AS (SELECT 0 AS level, node, nbr FROM k0 UNION ALL SELECT 1, node, nbr FROM k1),
ev AS (SELECT level, 'self' AS kind, idx AS "row", idx AS col FROM ix WHERE level < 2 UNION ALL SELECT lk.level, 'neigh', a.idx, b.idx FROM lk JOIN ix a ON a.level = lk.level AND a.node = lk.node JOIN ix b ON b.level = lk.level + 1 AND b.node = lk.nbr)
SELECT CAST(b AS INTEGER) AS block, kind, "row", col FROM ev, (SELECT unnest(range(0, 2)) AS b) WHERE b <= 1 - level""")
def subgraph_blocks(spark, sf_dir):
    levels, links = subgraphs.sample_levels(users_of(spark, sf_dir), edges_of(spark, sf_dir), [3, 2], SEED)
    return subgraphs.blocks(levels, links, 2)


@query(f"WITH {E} SELECT src AS node, dst AS nbr FROM e WHERE {u('src', 'dst')} >= 0.4")
def edge_drop(spark, sf_dir):
    return subgraphs.drop_edges(edges_of(spark, sf_dir).select(F.col("src").alias("node"), F.col("dst").alias("nbr")), 0.4, SEED)


@query(f"WITH {FEATURES} SELECT node, fid, v FROM f WHERE {u('node', 'fid')} >= 0.3")
def feature_mask(spark, sf_dir):
    return subgraphs.mask_features(features_of(spark, sf_dir), 0.3, SEED)


@query(f"WITH {CUM}, z AS (SELECT node, ns, {u('node', 'ns', '0')} AS u FROM (SELECT {T2} + p_partkey AS node, CAST(2 AS INTEGER) AS ns FROM part)) SELECT z.node, cu.node AS drawn FROM z JOIN cu ON cu.ns = z.ns AND u >= lo AND u < hi")
def global_shuffle(spark, sf_dir):
    return pairs.global_shuffle(parts_of(spark, sf_dir), sampling.negative_distribution(frequencies_of(spark, sf_dir)), SEED)


EMB = """em AS (SELECT vec_id AS id, k, CAST(embedding[k] AS DOUBLE) AS x, label FROM embeddings, (SELECT unnest(range(1, 65)) AS k))"""


def _matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("row"), F.col("vec_id").alias("col"), (1.0 + F.col("vec_id") % 3).alias("x"))


def _long(df: DataFrame) -> DataFrame:
    return df.select("row", F.posexplode("vec").alias("k", "z")).select("row", (F.col("k") + 1).cast("long").alias("k"), F.round("z", 5).alias("z"))


@query(f"WITH {EMB} SELECT label AS \"row\", k, round(sum(x * (1.0 + id % 3)), 5) AS z FROM em GROUP BY label, k")
def sum_aggregate(spark, sf_dir):
    return _long(tensors.sum_aggregate(_matrix(spark, sf_dir), vectors_of(spark, sf_dir), DIM))


@query(f"WITH {EMB} SELECT label AS \"row\", k, round(sum(x * (1.0 + id % 3)) / sum(1.0 + id % 3), 5) AS z FROM em GROUP BY label, k")
def mean_aggregate(spark, sf_dir):
    return _long(tensors.mean_aggregate(_matrix(spark, sf_dir), vectors_of(spark, sf_dir), DIM))


@query(f"WITH {E}, x AS (SELECT src, dst, exp(w - max(w) OVER (PARTITION BY src)) AS ex FROM e) SELECT src, dst, round(ex / sum(ex) OVER (PARTITION BY src), 6) AS p FROM x")
def edge_softmax(spark, sf_dir):
    out = tensors.edge_softmax(edges_of(spark, sf_dir), "src", "w")
    return rounded(out.select("src", "dst", "p"), "p")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: CAST(t[1] AS DOUBLE) * t[2])), 5) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def batch_dot(spark, sf_dir):
    vectors = vectors_of(spark, sf_dir)
    near = vectors.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return rounded(tensors.batch_dot(near, vectors, vectors), "z", digits=5)


@query("SELECT vec_id AS \"row\", k, round((exp(e1) * CAST(embedding[k] AS DOUBLE) + exp(e2) * CAST(embedding[k + 32] AS DOUBLE)) / (exp(e1) + exp(e2)), 5) AS z FROM (SELECT *, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2 FROM embeddings), (SELECT unnest(range(1, 33)) AS k)")
def weighted_average(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).select(F.col("id").alias("row"), F.slice("vec", 1, 2).alias("weights"), "vec")
    return _long(tensors.weighted_average(rows, 2, 32))


@query("SELECT vec_id AS id, label AS v FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id, CAST(-1 AS INTEGER) FROM embeddings WHERE label = 3")
def assemble_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("v"))
    return tensors.upsert(e, e.filter("v = 3").withColumn("v", F.lit(-1)))


@query("SELECT vec_id AS id, k, round(CAST(embedding[k] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda t: CAST(t AS DOUBLE) * t))), 5) AS z FROM embeddings, (SELECT unnest(range(1, 65)) AS k)")
def l2_normalized(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).select(F.col("id").alias("row"), l2_normalize(F.col("vec")).alias("vec"))
    return _long(rows).withColumnRenamed("row", "id")


SCORES = """sc AS (SELECT a.vec_id AS q, b.vec_id AS item, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: CAST(t[1] AS DOUBLE) * t[2])) AS score
FROM (SELECT * FROM embeddings WHERE label = 0) a, embeddings b), rk AS (SELECT q, item, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS rank FROM sc)"""


@query(f"WITH {SCORES} SELECT q, item, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10")
def topk_inner_product(spark, sf_dir):
    """The ten best items for each vector of class 0, a stated query set, among all vectors."""
    queries = table(spark, sf_dir, "embeddings").filter("label = 0").select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(metrics.top_inner_products(queries, vectors_of(spark, sf_dir), 10), "score", digits=5)


@query(f"WITH {SCORES} SELECT CAST(20 AS INTEGER) AS k, count(*) FILTER (WHERE rank <= 20) AS hit, count(*) AS total, count(*) FILTER (WHERE rank <= 20) / count(*) AS rate FROM rk WHERE item = q + 1")
def hit_rate_at_k(spark, sf_dir):
    """Whether the vector of the next id is among the 20 best of each vector of class 0"""
    queries = table(spark, sf_dir, "embeddings").filter("label = 0").select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("vec"))
    return metrics.hit_rate(queries, vectors_of(spark, sf_dir), queries.select("q", (F.col("q") + 1).alias("item")), 20)


@query("""WITH x AS (SELECT 'quality' AS label, quality AS y, CAST(n_chars > 800 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'toxic', toxic, CAST(n_chars < 300 AS INTEGER) FROM labels JOIN documents USING (doc_id)),
g AS (SELECT label, sum(y * p) AS tp, sum(p) AS ps, sum(y) AS ts FROM x GROUP BY label) SELECT round(2 * sum(tp) / (sum(ps) + sum(ts)), 6) AS micro_f1, round(avg(CASE WHEN ps + ts > 0 THEN 2 * tp / (ps + ts) ELSE 0.0 END), 6) AS macro_f1 FROM g""")
def f1(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    both = F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").alias("y"), (F.col("n_chars") > 800).cast("int").alias("predicted")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("y"), (F.col("n_chars") < 300).cast("int").alias("predicted")),
    )
    return rounded(metrics.f1(d.select(F.inline(both))), "micro_f1", "macro_f1")


@query("""WITH x AS (SELECT n_chars AS s, sum(quality) AS p, sum(1 - quality) AS n FROM labels JOIN documents USING (doc_id) GROUP BY n_chars), b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x)
SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b""")
def auc(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(metrics.auc(d.select(F.col("n_chars").alias("score"), F.col("quality").alias("y"))), "auc")


@query("SELECT doc_id AS node, CAST(p AS INTEGER) AS position, CASE p WHEN 0 THEN quality ELSE toxic END AS label FROM labels, (SELECT unnest(range(0, 2)) AS p)")
def label_matrix(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node"), F.array("quality", "toxic").cast("array<int>").alias("labels"))
    return pairs.label_matrix(labels, 2, 1).select("node", "position", F.col("label").cast("int").alias("label"))


@query("SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE floor(epoch(ts)) >= (SELECT max(floor(epoch(ts))) - 86400 FROM events)")
def param_expiry(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("ts"))
    return parameters.expire(rows, rows.agg(F.max("ts")).first()[0], 86400)


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60")
def freq_filter(spark, sf_dir):
    ids_ = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return parameters.admit(parameters.stream_counts(ids_), 60)


def part_numbers(spark, sf_dir):
    cells = F.array(F.struct(F.lit(1).alias("fid"), F.col("p_size").cast("double").alias("v")), F.struct(F.lit(2).alias("fid"), (F.col("p_retailprice") / 1000).alias("v")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.inline(cells))


PART_NUMBERS = "x AS (SELECT p_partkey AS node, 1 AS fid, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 2, p_retailprice / 1000 FROM part)"


@query(f"WITH {PART_NUMBERS} SELECT node, fid, round(v / (sum(v) OVER (PARTITION BY node) + 1e-7), 6) AS v FROM x WHERE v <> 0")
def normalized_features(spark, sf_dir):
    return rounded(datasets.normalize_rows(part_numbers(spark, sf_dir)), "v")


@query(f"""WITH {PART_NUMBERS}, s AS (SELECT fid, avg(v) AS m, stddev_pop(v) AS d FROM x WHERE node % 10 < 7 GROUP BY fid)
SELECT node, fid, round((v - m) / d, 6) + 0.0 AS v FROM x JOIN s USING (fid) WHERE v <> m""")
def standardized_features(spark, sf_dir):
    features = part_numbers(spark, sf_dir)
    return rounded(datasets.standardize(features, features.filter("node % 10 < 7")), "v")


def _lines(rows: DataFrame, *parts: str) -> DataFrame:
    return rows.select(F.concat_ws(" ", *[F.col(p).cast("string") for p in parts]).alias("value"))


@query("SELECT l_orderkey AS src, l_partkey AS dst, CAST(l_quantity AS DOUBLE) AS w FROM lineitem WHERE l_quantity <= 10")
def edge_lines(spark, sf_dir):
    """Weights over 10 are out of range, so their lines go."""
    lines = _lines(table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int")), "l_orderkey", "l_partkey", "q")
    return text.parse_edges(lines).withColumn("w", F.col("w").cast("double"))


@query("SELECT p_partkey AS node, CAST(CASE WHEN p_size > 25 THEN p_size ELSE 1 END AS DOUBLE) AS weight FROM part WHERE p_size <> 7")
def node_lines(spark, sf_dir):
    """A node without a weight has 1; a line whose node is no number goes."""
    part = table(spark, sf_dir, "part").withColumn("id", F.when(F.col("p_size") == 7, "x7").otherwise(F.col("p_partkey").cast("string")))
    lines = part.select(F.concat_ws(" ", "id", F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))).alias("value"))
    return text.parse_nodes(lines).withColumn("weight", F.col("weight").cast("double"))


@query(f"""WITH {SEQ}, b AS (SELECT user_id, min(i) AS stop FROM s WHERE event_id % 50 = 9 GROUP BY user_id)
SELECT s.event_id AS node, CAST(i AS INTEGER) AS place FROM s LEFT JOIN b USING (user_id) WHERE i < coalesce(stop, i + 1)""")
def sequence_lines(spark, sf_dir):
    """A sequence ends before its first part that is no number."""
    part = lambda x: F.when(x % 50 == 9, F.lit("?")).otherwise(x.cast("string"))
    lines = sequences_of(spark, sf_dir).select(F.array_join(F.transform("nodes", part), " ").alias("value"))
    return text.parse_sequences(lines).select(F.posexplode("nodes").alias("place", "node")).select("node", "place")


@query("SELECT l_orderkey AS node, l_partkey AS id, CAST(l_quantity AS DOUBLE) AS w FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 10) AND l_quantity < 10 AND l_partkey % 3 = 0")
def adjacency_lines(spark, sf_dir):
    """A line with a malformed pair goes as a whole."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity <= 10 and (l_partkey % 3 = 0 or l_quantity = 10)")
    pair = F.concat_ws(":", "l_partkey", F.when(F.col("l_quantity") == 10, "ten").otherwise(F.col("l_quantity").cast("int").cast("string")))
    value = F.concat_ws(" ", F.col("l_orderkey"), F.array_join(F.collect_list(pair), " "))
    parsed = text.parse_adjacency(lines.groupBy("l_orderkey").agg(value.alias("value")))
    return parsed.select("node", F.inline("pairs")).withColumn("w", F.col("w").cast("double"))


@query("SELECT doc_id AS src, doc_id + 1 AS dst, doc_id AS node, quality, toxic FROM labels")
def labelled_edge_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("next", F.col("doc_id") + 1).withColumn("own", F.col("doc_id"))
    parsed = text.parse_labelled_edges(_lines(rows, "doc_id", "next", "own", "quality", "toxic"))
    return parsed.select("src", "dst", "node", F.col("labels")[0].alias("quality"), F.col("labels")[1].alias("toxic"))


@query("SELECT doc_id AS node, quality, toxic FROM labels")
def label_lines(spark, sf_dir):
    parsed = text.parse_labels(_lines(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic"))
    return parsed.select("node", F.col("labels")[0].alias("quality"), F.col("labels")[1].alias("toxic"))


@query("""SELECT o_orderkey AS "row", CAST(o_orderkey % 2 AS DOUBLE) AS y, CAST(2 AS DOUBLE) AS weight, l_partkey AS id, CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE l_quantity END AS DOUBLE) AS w
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def sample_lines(spark, sf_dir):
    """Ranking samples: a label with a weight, features with and without values; a malformed value drops the line."""
    value = F.when(F.col("l_quantity") == 50, "fifty").otherwise(F.col("l_quantity").cast("int").cast("string"))
    pair = F.concat_ws(":", "l_partkey", F.when((F.col("l_linenumber") > 1) | (F.col("l_quantity") == 50), value))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(
        F.concat_ws(" ", F.concat((F.col("row") % 2).cast("string"), F.lit(":2")), F.array_join(F.collect_list(pair), " ")).alias("value"))
    parsed = text.parse_samples(lines).select("row", "y", "weight", F.inline("pairs"))
    return parsed.select("row", F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), "id", F.col("w").cast("double").alias("w"))


@query("SELECT concat_ws(' ', vec_id, label, vec_id % 5) AS value FROM embeddings")
def prediction_lines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.array(F.col("label").cast("long"), F.col("vec_id") % 5).alias("vec"))
    return text.format_predictions(e)


@query(f"WITH {SEQ} SELECT string_agg(event_id, ' ' ORDER BY i) AS value FROM s GROUP BY user_id")
def sequence_dump(spark, sf_dir):
    return text.format_sequences(sequences_of(spark, sf_dir))


@query(f"WITH RECURSIVE {R}, {WALK.format(**STARTS, pick=UNIFORM_PICK, length=3)} SELECT string_agg(node, ' ' ORDER BY step) AS value FROM walk GROUP BY start, epoch HAVING count(*) > 1")
def walk_sequences_dump(spark, sf_dir):
    return text.format_sequences(walks.sequences(walks.random_walks(users_of(spark, sf_dir), edges_of(spark, sf_dir), 3, SEED, epochs=2)))


@query(f"WITH {EMB} SELECT label AS \"row\", k, round(sum(x * (1.0 + id % 3)), 5) AS z FROM em GROUP BY label, k")
def embedding_lookup(spark, sf_dir):
    found = _matrix(spark, sf_dir).select("row", F.col("col").alias("fid"), F.col("x").alias("v"))
    return _long(lookups.embedding_lookup(found, vectors_of(spark, sf_dir), DIM))


@query(f"""WITH g AS (SELECT unnest(range(0, 2)) AS g), r AS (SELECT DISTINCT label FROM embeddings), em AS (SELECT label, vec_id % 3 AS g, k, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 5)) AS k) WHERE vec_id % 3 < 2 OR label > 2)
SELECT r.label AS "row", CAST(g.g * 4 + kk.k AS BIGINT) AS k, round(coalesce(sum(x), 0.0), 5) AS z FROM r, g, (SELECT unnest(range(1, 5)) AS k) kk LEFT JOIN em ON em.label = r.label AND em.g = g.g AND em.k = kk.k GROUP BY 1, 2""")
def group_embedding_lookup(spark, sf_dir):
    """Features of types 0 and 1 side by side; those of type 2 are of no group."""
    e = table(spark, sf_dir, "embeddings").withColumn("fid", encode_id((F.col("vec_id") % 3).cast("int"), F.col("vec_id")))
    weights = e.select(F.col("fid").alias("id"), F.slice(F.col("embedding"), 1, 4).cast("array<double>").alias("vec"))
    return _long(lookups.group_embedding_lookup(e.select(F.col("label").alias("row"), "fid", F.lit(1.0).alias("v")), weights, [0, 1], 4))


@query(f"WITH {EMB}, n AS (SELECT label, vec_id % 10 AS c, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT n.label AS \"row\", k, round(sum(x * n), 5) AS z FROM n JOIN em ON em.id = n.c GROUP BY n.label, k")
def hidden_lookup(spark, sf_dir):
    """Columns count modulo 10."""
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("row"), F.col("vec_id").alias("col"), F.lit(1.0).alias("x"))
    return _long(tensors.hidden_lookup(x, vectors_of(spark, sf_dir).filter("id < 10"), 10, DIM))


@query(f"SELECT {T2} + p_partkey AS node, CASE WHEN p_size > 25 THEN dense_rank() OVER (PARTITION BY p_size > 25 ORDER BY p_partkey) - 1 ELSE -1 END AS idx FROM part")
def index_lookup(spark, sf_dir):
    known = graph.dense_index(table(spark, sf_dir, "part").filter("p_size > 25").select(encode_id(F.lit(2), F.col("p_partkey")).alias("node")))
    return lookups.lookup_index(parts_of(spark, sf_dir), known)


@query(f"SELECT {T1} + c_custkey AS node, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 64) AS BIGINT) AS batch FROM customer")
def mini_batches(spark, sf_dir):
    return pairs.batches(users_of(spark, sf_dir), 64)


@query(f"WITH {DIRECTED} SELECT src AS node, dst AS id, CAST(row_number() OVER (PARTITION BY src ORDER BY dst >> 48, w, dst) - 1 AS INTEGER) AS place FROM e")
def neighbors_by_weight(spark, sf_dir):
    adj = graph.adjacency(directed_of(spark, sf_dir)).select("node", pairs.sort_pairs(F.col("pairs")).alias("pairs"))
    return adj.select("node", F.posexplode("pairs").alias("place", "pair")).select("node", F.col("pair.id").alias("id"), "place")


@query(f"WITH {FEATURES} SELECT node, fid, round(v, 6) AS v FROM f WHERE v <= 1.2")
def bounded_features(spark, sf_dir):
    return rounded(pairs.bounded_features(features_of(spark, sf_dir), 1.2), "v")


@query(f"WITH {DIRECTED}, {FEATURES} SELECT DISTINCT node FROM f WHERE node IN (SELECT dst FROM e WHERE w > 1)")
def member_nodes(spark, sf_dir):
    hot = directed_of(spark, sf_dir).filter("w > 1").select(F.col("dst").alias("node"))
    return pairs.members(features_of(spark, sf_dir).select("node").distinct(), hot)


@query(f"SELECT o_orderkey AS \"row\", {T1} + o_custkey AS node FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def user_of_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = lines.select(F.col("o_orderkey").alias("row"), encode_id(F.lit(2), F.col("l_partkey")).alias("fid"))
    samples = parts.union(lines.select("o_orderkey", encode_id(F.lit(1), F.col("o_custkey"))).distinct())
    return instances.node_of_rows(samples, 1)


@query(f"SELECT {T1} + c_custkey AS node, CASE WHEN {u(f'{T1} + c_custkey')} < 0.7 THEN 'train' ELSE 'test' END AS stage FROM customer")
def train_split(spark, sf_dir):
    return datasets.train_split(users_of(spark, sf_dir), 0.7, SEED)


@query(f"WITH {DIRECTED} SELECT DISTINCT * FROM (SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM e UNION ALL SELECT dst, src, 1 FROM e)")
def undirected_links(spark, sf_dir):
    return datasets.undirected(directed_of(spark, sf_dir))


NEXT = """p AS (SELECT a.vec_id AS id, s, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: CAST(t[1] AS DOUBLE) * t[2])) AS z
FROM embeddings a, (SELECT unnest(range(1, 3)) AS s) JOIN embeddings b ON b.vec_id = a.vec_id + s)"""


def _next_scores(spark, sf_dir) -> DataFrame:
    """id, s, z, y: inner products with the vectors of the next id, which are positives, and of the one after it"""
    vectors = vectors_of(spark, sf_dir)
    met = vectors.select(F.col("id").alias("a"), F.explode(F.array(F.lit(1), F.lit(2))).alias("s")).withColumn("b", F.col("a") + F.col("s"))
    return tensors.batch_dot(met, vectors, vectors).select(F.col("a").alias("id"), F.col("s").cast("long").alias("s"), "z", (2 - F.col("s")).alias("y"))


@query(f"""WITH {NEXT}, a AS (SELECT id, z FROM p WHERE s = 1), b AS (SELECT id, z FROM p WHERE s = 2), l AS (SELECT avg((1 - a.z + b.z) ** 2) AS loss FROM a, b),
g AS (SELECT a.id, CAST(1 AS BIGINT) AS s, avg(-2 * (1 - a.z + b.z)) / (SELECT count(*) FROM a) AS g FROM a, b GROUP BY a.id UNION ALL SELECT b.id, 2, avg(2 * (1 - a.z + b.z)) / (SELECT count(*) FROM b) FROM a, b GROUP BY b.id)
SELECT id, s, round(1e4 * g, 4) AS g, round(loss, 4) AS loss FROM g, l""")
def pairwise_loss(spark, sf_dir):
    """Every positive against every negative, from sums; the SQL makes all the pairs."""
    found = objectives.pairwise_square(_next_scores(spark, sf_dir))
    return found.select("id", "s", F.round(1e4 * F.col("g"), 4).alias("g"), F.round("loss", 4).alias("loss"))


@query(f"WITH {NEXT}, q AS (SELECT id, s, 1 / (1 + exp(-z)) AS p FROM p) SELECT id, s, round(CASE WHEN p >= 0.69 OR p <= 0.31 THEN -p * ln(p) ELSE 0.0 END, 6) + 0.0 AS loss FROM q")
def self_training_loss(spark, sf_dir):
    found = _next_scores(spark, sf_dir)
    return found.select("id", "s", (F.round(objectives.self_training(F.col("z"))[0], 6) + 0.0).alias("loss"))


@query("""WITH v AS (SELECT vec_id AS id, vec_id // 32 AS batch, list_transform(embedding, lambda t: CAST(t AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda q: CAST(q AS DOUBLE) * q)))) AS l FROM embeddings),
w AS (SELECT a.id, a.batch, a.l, b.l AS r FROM v a JOIN v b ON b.id = a.id + 1),
c AS (SELECT a.id, a.batch, a.id = b.id AS own, exp(list_sum(list_transform(list_zip(a.l, b.r), lambda t: t[1] * t[2])) / 0.5) AS x, exp(list_sum(list_transform(list_zip(a.l, b.l), lambda t: t[1] * t[2])) / 0.5) AS l,
exp(list_sum(list_transform(list_zip(a.r, b.r), lambda t: t[1] * t[2])) / 0.5) AS r FROM w a JOIN w b ON a.batch = b.batch),
s AS (SELECT id, batch, sum(x) AS x, sum(x) FILTER (WHERE own) AS d, coalesce(sum(l) FILTER (WHERE NOT own), 0) AS l, coalesce(sum(r) FILTER (WHERE NOT own), 0) AS r FROM c GROUP BY id, batch)
SELECT id, batch, round(-ln(d / (x + l) + d / (x + r)), 5) AS loss FROM s""")
def contrastive_loss(spark, sf_dir):
    """A vector and that of the next id are two views of one; batches of 32."""
    vectors = vectors_of(spark, sf_dir)
    rows = vectors.join(vectors.select((F.col("id") - 1).alias("id"), F.col("vec").alias("r")), "id")
    rows = rows.select(F.col("id").alias("row"), F.floor(F.col("id") / 32).alias("batch"), F.col("vec").alias("l"), "r")
    return objectives.contrastive(rows, 0.5).select(F.col("row").alias("id"), "batch", F.round("loss", 5).alias("loss"))


@query(f"""WITH {NEXT} SELECT round(avg(greatest(-v, 0.0) + ln(1 + exp(-abs(v)))), 6) AS loss FROM (SELECT CASE WHEN s = 1 THEN z ELSE -z END AS v FROM p)""")
def skip_gram_loss(spark, sf_dir):
    """The cross-entropy of pairs with label 1 and 0"""
    found = _next_scores(spark, sf_dir)
    return found.agg(F.round(F.avg(objectives.cross_entropy(F.col("z"), F.col("y"))), 6).alias("loss"))


@query(f"""WITH {NEXT}, g AS (SELECT id AS src, id + s AS dst, CASE WHEN s = 1 THEN 1 ELSE 0 END - 1 / (1 + exp(-z)) AS g FROM p), {EMB},
d AS (SELECT src AS id, k, avg(g * x) AS d FROM g JOIN em ON em.id = dst GROUP BY src, k) SELECT em.id, k, round(x + 0.5 * coalesce(d, 0.0), 5) + 0.0 AS z FROM em LEFT JOIN d USING (id, k)""")
def skip_gram_step(spark, sf_dir):
    """The input table after one step"""
    vectors = vectors_of(spark, sf_dir)
    met = _next_scores(spark, sf_dir).select(F.col("id").alias("src"), (F.col("id") + F.col("s")).alias("dst"), "y")
    return _long(embeddings.step(met, vectors, vectors, DIM, 0.5)[0].withColumnRenamed("id", "row")).withColumnRenamed("row", "id")
