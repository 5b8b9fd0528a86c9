"""From bands of signatures to groups of near copies, without the pairs within a group.

The nodes are classes of equal sets, told apart by size and two hashes, so a set counts once however many documents have it,
and a document of several texts is in several classes. Each band's bucket links its classes to its smallest one alone (a
star). Verified stars give components. Classes of buckets that still hold several components are joined by their rarest set
members instead, which loses no link, and pairs across components are compared. So every link within a bucket is in one
component or was found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_small, settled, stored

#: What tells classes apart.
SET = ["n", "set_1", "set_2"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id reachable.

    Alternates large and small stars until nothing changes, which takes about as many rounds as the number of ids has digits.
    """
    spark = edges.sparkSession
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    last = None
    while True:
        edges = settled(spark, lambda: _stars(edges), "edges")  # noqa: B023
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")), F.sum(F.xxhash64("m", "v").cast("decimal(38,0)"))).first()
        if size == last:
            break
        last = size
    return edges.groupBy(F.col("v").alias("id")).agg(F.min("m").alias("component")).union(
        edges.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, and then its smaller ones, are linked to its smallest neighbour."""
    both = edges.union(edges.select("m", "v").toDF("v", "m"))
    least = both.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("least"))
    large = both.join(least, "v").filter("m > v").select(F.col("m").alias("v"), F.col("least").alias("m"))
    large = large.union(edges.join(least, "v").select("v", F.col("least").alias("m"))).filter("v <> m").distinct()
    low = large.groupBy("v").agg(F.min("m").alias("least"))
    small = large.join(low, "v").filter("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return small.union(low.select("v", F.col("least").alias("m"))).filter("v <> m").distinct()


class Classes:
    """Classes of the equal sets of documents, and verified links between classes.

    marks: (doc_id, n, set_1, set_2, bands, sig) of each document, stored. A set of no members, or one without a doc_id, is in no
    class. sets gives (id, members) of a table (id, n, set_1, set_2, text), of those rows whose text has that set. likely: SQL
    that says whether the columns of two rows (n, sig), with these prefixes, may belong to a link. A link has 100 *
    intersection >= percent * union.
    """

    def __init__(self, documents: DataFrame, marks: DataFrame, sets: Callable[[DataFrame], DataFrame], likely: Callable[[str, str], str], percent: int):
        self.documents, self.marks, self.sets, self.likely, self.percent = documents, marks, sets, likely, percent
        self.whole = marks.filter("n > 0 and doc_id is not null")
        # In the order of the smallest doc_ids, so that a bucket's hub is its oldest text. An id stays what it is once it is written.
        ordered = self.whole.groupBy(*SET).agg(F.min("doc_id").alias("least")).orderBy("least")
        self.table = stored(ordered.withColumn("id", F.monotonically_increasing_id()), "classes")

    def links(self) -> DataFrame:
        """(a, b), whose components are those of all links between classes that share a band."""
        heads = self.table.join(self.marks.withColumnRenamed("doc_id", "least"), [*SET, "least"])
        about = stored(heads.select("id", "n", "sig").dropDuplicates(["id"]), "about")
        buckets = heads.select("id", F.explode("bands").alias("bucket"))
        hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("_last")).filter("hub < _last")
        shared = stored(buckets.join(hubs, "bucket").select("bucket", "id", "hub"), "buckets")
        stars = shared.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        first = self._verified(stars, about)
        placed = shared.join(components(first), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("g"))
        mixed = placed.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("bucket")
        rest = stored(placed.join(mixed, "bucket").select("id", "g").distinct(), "rest")
        pairs = self._by_rare_members(rest.join(about.select("id", "n"), "id"))
        return first.union(self._verified(pairs, about))

    def same_document(self) -> DataFrame:
        """(a, b): the classes of a doc_id that rows with different texts repeat are one."""
        of = self.whole.select("doc_id", *SET).join(self.table, SET).select("doc_id", "id")
        several = of.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("doc_id", "a")
        return of.join(several, "doc_id").select("a", F.col("id").alias("b"))

    def groups(self) -> DataFrame:
        """marks, each with the smallest doc_id reachable as group; null where it is in no class."""
        reached = components(self.links().union(self.same_document()))
        placed = self.table.join(reached, "id", "left").select(*SET, "least", F.coalesce("component", "id").alias("component"))
        smallest = placed.groupBy("component").agg(F.min("least").alias("group"))
        placed = placed.join(smallest, "component").select(*SET, "group")
        found = self.marks.select("doc_id", *SET).join(placed, SET, "left")
        return found.withColumn("group", F.when(F.col("doc_id").isNotNull(), F.col("group")))

    def _members(self, ids: DataFrame) -> DataFrame:
        """(id, members) of the classes with these ids (id), each read from one of its documents."""
        wanted = stored(self.table.join(ids, "id").select("id", *SET, "least"), "wanted")
        text = self.documents.select(F.col("doc_id").alias("least"), "text").join(broadcast_if_small(wanted), "least")
        return stored(self.sets(text.select("id", *SET, "text")).dropDuplicates(["id"]), "sets")

    def _by_rare_members(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of rows (id, g, n) with different g that may be links, with no other pair lost.

        With all members in one order, the rarest first, two sets that are alike enough share one of their first n -
        ceil(percent * n / 100) + 1 members. At the first that they share, each must also have enough members left for the overlap
        that a link needs. So texts that only have a frequent passage in common do not meet.
        """
        percent = self.percent
        members = self._members(rows.select("id")).join(rows, "id").select("id", "g", "n", F.explode("members").alias("member"))
        often = members.groupBy("member").agg(F.count("*").alias("often"), F.min("g").alias("lo"), F.max("g").alias("hi"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("often", "member"))
        ranked = members.join(often, "member").withColumn("rank", rank)
        rare = stored(ranked.filter(f"rank <= n - ceil({percent} * n / 100) + 1 and lo < hi").select("member", "id", "g", "n", "rank"), "rare")
        x, y = rare.toDF(*[f"{c}_x" for c in rare.columns]), rare.toDF(*[f"{c}_y" for c in rare.columns])
        near = F.expr(
            f"g_x < g_y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
            f" and (1 + least(n_x - rank_x, n_y - rank_y)) * {100 + percent} >= {percent} * (n_x + n_y)"
        )
        pairs = x.join(y, (F.col("member_x") == F.col("member_y")) & near)
        return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()

    def _verified(self, pairs: DataFrame, about: DataFrame) -> DataFrame:
        percent = self.percent

        def make() -> DataFrame:
            left, right = about.toDF("a", "n_a", "sig_a"), about.toDF("b", "n_b", "sig_b")
            able = pairs.join(left, "a").join(right, "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
            able = stored(able.filter(self.likely("a", "b")).select("a", "b", "n_a", "n_b"), "pairs")
            full = self._members(able.select(F.col("a").alias("id")).union(able.select("b")).distinct())
            both = able.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b")
            common = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("common"))
            return common.filter(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b")

        return settled(about.sparkSession, make, "links")
