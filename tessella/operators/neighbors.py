"""Neighbor feature averages, swing item similarity, hot-node selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.rng import uniform
from tessella.operators.lookups import lookup_features


#: Parts of the feature average and of swing for each of Spark's shuffle partitions: rows there are many times the edges, and a task sorts its own.
FINER = 8

#: Users that one user is compared with at once, counted once for each item, for swing's lists
LONGEST = 1 << 22


def average_features(edges: DataFrame, features: DataFrame) -> DataFrame:
    """node, fid, avg over all neighbors; those without features count, with feature 0"""
    parts = FINER * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    found = lookup_features(edges.select("src", F.col("dst").alias("node")).repartition(parts, "node"), features)
    sums = found.select(F.col("src").alias("node"), "fid", "v").repartition(parts, "node").groupBy("node", "fid").agg(F.sum("v").alias("s"))
    return sums.join(degree, "node").select("node", "fid", (F.col("s") / F.col("n")).alias("avg"))


def average_features_sampled(edges: DataFrame, features: DataFrame, count: int, seed: int) -> DataFrame:
    """The same over `count` uniform draws with replacement for nodes of more neighbors than that"""
    return average_features(sample_for_average(edges, count, seed), features)


def sample_for_average(edges: DataFrame, count: int, seed: int) -> DataFrame:
    by_src = Window.partitionBy("src")
    ranked = edges.select("src", "dst", (F.row_number().over(by_src.orderBy("dst")) - 1).alias("k"), F.count("*").over(by_src).alias("deg"))
    draws = ranked.filter((F.col("k") == 0) & (F.col("deg") > count)).select("src", "deg", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    draws = draws.select("src", F.floor(uniform(seed, "src", "draw") * F.col("deg")).cast("int").alias("k"))
    few = ranked.filter(F.col("deg") <= count).select("src", "dst")
    return few.union(draws.join(ranked.select("src", "k", "dst"), ["src", "k"]).select("src", "dst"))


def swing(contexts: DataFrame, alpha: float = 1.0, threshold: int | None = None, seed: int = 0) -> DataFrame:
    """i, j, score from contexts (user, item).

    For each two users of i, each other item j that they share gets 1/sqrt(|U|) 1/sqrt(|V|) / (alpha + shared), without i in
    any of the sets. threshold: an item of more users keeps each with probability threshold / users, which bounds the pairs
    that a popular item makes.
    """
    if threshold is None:
        return _swing_exact(contexts, alpha)
    contexts = contexts.select("user", "item").distinct()
    sizes = contexts.groupBy("user").agg(F.count("*").alias("n"))
    users = contexts.join(sizes, "user").filter("n > 1")
    degree = F.count("*").over(Window.partitionBy("item"))
    users = users.withColumn("degree", degree).filter(
        (F.col("degree") <= threshold) | (uniform(seed, "user", "item") < threshold / F.col("degree"))
    )
    a, b = users.toDF(*[f"{c}_a" for c in users.columns]), users.toDF(*[f"{c}_b" for c in users.columns])
    pairs = a.join(b, (F.col("item_a") == F.col("item_b")) & (F.col("user_a") < F.col("user_b")))
    pairs = pairs.select(F.col("item_a").alias("i"), F.col("user_a").alias("u"), F.col("user_b").alias("v"), F.col("n_a"), F.col("n_b"))
    first = contexts.select(F.col("user").alias("u"), F.col("item").alias("j"))
    second = contexts.select(F.col("user").alias("v"), F.col("item").alias("j"))
    shared = pairs.join(first, "u").join(second, ["v", "j"]).filter("i <> j")
    size = shared.groupBy("i", "u", "v").agg(F.count("*").alias("common"))
    part = 1 / (F.sqrt(F.col("n_a") - 1.0) * F.sqrt(F.col("n_b") - 1.0) * (alpha + F.col("common")))
    return shared.join(size, ["i", "u", "v"]).groupBy("i", "j").agg(F.sum(part).alias("score"))


def _swing_exact(contexts: DataFrame, alpha: float) -> DataFrame:
    """The same over all users, without a row of a shuffle for each two users of an item.

    Users are cut into blocks of about as many contexts, by ranges of ids. An item's users go to each block that has some of
    them as one list, and that block alone pairs its users u with the users v of at least as many items. Pairs that share
    one item alone are dropped before they become rows. An item's users are one row's list.
    """
    held = contexts.select("user", "item").filter("user is not null and item is not null")
    parts = FINER * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.count("*").over(Window.partitionBy("user")).alias("n")
    held = held.repartitionByRange(parts, "user").distinct().select("item", F.struct(n, "user", F.spark_partition_id().alias("block")).alias("x"))
    lists = held.filter("x.n > 1").repartition(parts, "item").groupBy("item").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    sent = lists.filter(F.size("xs") > 1).select("item", "xs", F.explode(F.array_distinct("xs.block")).alias("block"))
    sent = sent.withColumn("xs", F.slice("xs", F.array_position("xs.block", F.col("block")).cast("int"), F.size("xs"))).filter(F.size("xs") > 1)
    own = F.transform("xs", lambda x: x["block"] == F.col("block"))
    sent = sent.select("item", "block", F.col("xs.user").alias("users"), F.col("xs.n").alias("ns"), own.alias("own")).repartitionById(parts, "block")
    later = [F.slice(c, F.col("at") + 2, F.size("users")).alias(a) for c, a in (("users", "vs"), ("ns", "n_vs"))]
    rows = sent.select("item", "block", "users", "ns", F.posexplode("own").alias("at", "own")).filter("own")
    rows = rows.select("block", F.get("users", F.col("at")).alias("u"), F.get("ns", F.col("at")).alias("n_u"), "item", *later).filter(F.size("vs") > 0)
    user = ["block", "u", "n_u"]
    groups = _in_cells(rows, user).groupBy(*user, "cell").agg(F.collect_list(F.struct("item", "vs", "n_vs")).alias("rows"))
    groups = groups.withColumn("all", F.sort_array(F.flatten("rows.vs")))
    groups = groups.withColumn("again", F.filter("all", lambda v, k: v == F.get(F.col("all"), k - 1)))
    found = groups.select(*user, "again", F.inline("rows")).withColumn("v", F.explode(F.array_intersect("vs", "again")))
    found = found.withColumn("n_v", F.get("n_vs", (F.array_position("vs", F.col("v")) - 1).cast("int")))
    shared = found.groupBy(*user, "v", "n_v").agg(F.sort_array(F.collect_list("item")).alias("items"))
    part = 1 / (F.sqrt(F.col("n_u") - 1.0) * F.sqrt(F.col("n_v") - 1.0) * (alpha + F.size("items") - 1))
    ends = shared.select(part.alias("part"), "items", F.posexplode("items").alias("at", "i"))
    ends = ends.select("i", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("j"), "part")
    scores = ends.groupBy("i", "j").agg(F.sum("part").alias("score"))
    return scores.select(F.inline(F.array(F.struct("i", "j", "score"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "score"))))


def _in_cells(rows: DataFrame, user: list[str]) -> DataFrame:
    """rows with cell: 0, and for a user of more than LONGEST entries in vs one row for each entry, its cell by a hash of v"""
    cells = F.ceil(F.sum(F.size("vs")).over(Window.partitionBy(*user)) / LONGEST)
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("cell"), "vs", "n_vs"))
    each = F.transform(F.arrays_zip("vs", "n_vs"), lambda x: F.struct(
        F.pmod(F.xxhash64(x["vs"]), F.col("cells")).alias("cell"), F.array(x["vs"]).alias("vs"), F.array(x["n_vs"]).alias("n_vs")
    ))
    return rows.withColumn("cells", cells).select(*user, "item", F.inline(F.when(F.col("cells") == 1, whole).otherwise(each)))


def top_by_degree(degrees: DataFrame, share: float) -> DataFrame:
    """The share of nodes with the largest out-degree, smaller ids first where equal"""
    sources = degrees.filter("out_degree > 0")
    return sources.orderBy(F.desc("out_degree"), "node").limit(int(sources.count() * share))


def important(degrees: DataFrame, threshold: float) -> DataFrame:
    if threshold < 0:
        raise ValueError("threshold is not negative")
    return degrees.filter("out_degree > 0").filter((F.col("in_degree") + 1) / (F.col("out_degree") + 1) > threshold)


def random_share(nodes: DataFrame, share: float, seed: int) -> DataFrame:
    return nodes.filter(uniform(seed, "node") < share)


def page(nodes: DataFrame, cursor: int, count: int) -> DataFrame:
    return nodes.orderBy("node").offset(cursor).limit(count)
