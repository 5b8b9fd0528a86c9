"""Blank-separated text records: readers that drop malformed lines, and writers.

Ids are unsigned 64-bit numbers. A weight outside [-10, 10] or a malformed part drops the line, as does an empty list.
A node's weight is 1 where missing, and is not range-checked.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ids import weight_in_range

PAIR = "struct<id:bigint,w:float>"
#: Fixed value: the name of the only namespace where no file names them.
NO_NAMESPACES = "EMPTY_CONFIG_FILE"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of all files under path; raises if there are none."""
    return spark.read.option("recursiveFileLookup", True).text(path).filter(F.length(F.trim("value")) > 0)


def _parts(rows: DataFrame, *others: str) -> DataFrame:
    """others, and p, the parts of value. A generator of one row: else filters on what is parsed would split the line again for each use of p."""
    return rows.select(*others, F.explode(F.array(F.split(F.trim("value"), " +"))).alias("p"))


def _once(p: DataFrame, *columns: Column) -> DataFrame:
    """The columns, parsed once for the filters and the result."""
    return p.select(F.inline(F.array(F.struct(*columns))))


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def to_id(text: Column) -> Column:
    """An unsigned number of up to 20 digits as a long with the same bits; null if malformed."""
    number = F.when(text.rlike("^[0-9]{19,20}$"), text.cast("decimal(20,0)"))
    wrapped = F.when(number >= _big(1 << 63), number - _big(1 << 64)).otherwise(number)
    return F.when(text.rlike("^[0-9]{1,18}$"), text.cast("long")).when(number < _big(1 << 64), wrapped.cast("long"))


def from_id(node: Column) -> Column:
    number = node.cast("decimal(20,0)")
    return F.when(node < 0, number + _big(1 << 64)).otherwise(number).cast("string")


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), text.cast("float"))


def parse_nodes(rows: DataFrame) -> DataFrame:
    """node, weight, from lines (value)"""
    p = _parts(rows)
    return _once(p, to_id(F.get("p", F.lit(0))).alias("node"), F.coalesce(_number(F.get("p", F.lit(1))), F.lit(1.0).cast("float")).alias("weight")).filter("node is not null")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return parse_nodes(lines(spark, path))


def parse_edges(rows: DataFrame) -> DataFrame:
    """src, dst, w, from lines (value)"""
    p = _parts(rows)
    w = F.when(F.size("p") > 2, _number(F.get("p", F.lit(2)))).otherwise(F.lit(1.0).cast("float"))
    edges = _once(p, to_id(F.get("p", F.lit(0))).alias("src"), to_id(F.get("p", F.lit(1))).alias("dst"), w.alias("w"))
    return edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & weight_in_range(F.col("w")))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(lines(spark, path))


def parse_sequences(rows: DataFrame) -> DataFrame:
    """nodes: the ids up to the first part that is none, from lines (value)"""
    ids = _once(_parts(rows), F.transform("p", to_id).alias("ids"))
    bad = F.array_position(F.transform("ids", lambda x: x.isNull()), True)
    seq = F.when(bad > 0, F.slice("ids", F.lit(1), (bad - 1).cast("int"))).otherwise(F.col("ids"))
    return _once(ids, seq.alias("nodes")).filter(F.size("nodes") > 0)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return parse_sequences(lines(spark, path))


def parse_adjacency(rows: DataFrame) -> DataFrame:
    """node, pairs(id, w): adjacency, features and samples, from lines (value)"""
    p = _parts(rows)

    def pair(part: Column) -> Column:
        kv = F.split(part, ":")
        return F.when(F.size(kv) == 2, F.struct(to_id(kv[0]).alias("id"), _number(kv[1]).alias("w")))

    found = _once(p, to_id(F.get("p", F.lit(0))).alias("node"), F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), pair).alias("pairs"))
    good = F.forall("pairs", lambda x: x.isNotNull() & x["id"].isNotNull() & F.coalesce(weight_in_range(x["w"]), F.lit(False)))
    return found.filter(F.col("node").isNotNull() & (F.size("pairs") > 0) & good)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return parse_adjacency(lines(spark, path))


def parse_labels(rows: DataFrame) -> DataFrame:
    """node, labels, from lines (value)"""
    p = _parts(rows)
    labels = F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.when(x.rlike("^-?[0-9]+$"), x.cast("int")))
    found = _once(p, to_id(F.get("p", F.lit(0))).alias("node"), labels.alias("labels"))
    return found.filter(F.col("node").isNotNull() & (F.size("labels") > 0) & F.forall("labels", lambda x: x.isNotNull()))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(lines(spark, path))


def parse_labelled_edges(rows: DataFrame) -> DataFrame:
    """src, dst, node, labels, from lines (value)"""
    p = _parts(rows)
    labels = F.transform(F.slice("p", F.lit(4), F.greatest(F.size("p") - 3, F.lit(0))), lambda x: F.when(x.rlike("^-?[0-9]+$"), x.cast("int")))
    found = _once(p, *[to_id(F.get("p", F.lit(k))).alias(c) for k, c in enumerate(("src", "dst", "node"))], labels.alias("labels"))
    return found.na.drop(subset=["src", "dst", "node"]).filter((F.size("labels") > 0) & F.forall("labels", lambda x: x.isNotNull()))


def read_labelled_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_labelled_edges(lines(spark, path))


def read_namespaces(spark: SparkSession, path: str) -> DataFrame:
    """name, ns_id; lines with # or // are comments; a repeated id raises when read. An empty path gives one namespace, 0."""
    if not path:
        return spark.createDataFrame([(NO_NAMESPACES, 0)], "name string, ns_id int")
    p = _parts(lines(spark, path).filter(~F.col("value").rlike("#|//")))
    rows = p.select(p.p[0].alias("name"), p.p[1].cast("int").alias("ns_id"))
    once = rows.groupBy("ns_id").agg(F.count("*").alias("n"), F.first("name").alias("name"))
    return once.select("name", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated namespace "), F.col("ns_id")))).otherwise(F.col("ns_id")).cast("int").alias("ns_id"))


def read_frequencies(spark: SparkSession, path: str, namespaces: DataFrame) -> DataFrame:
    """node, freq; a frequency of nought or less, or a node of no namespace, raises when read."""
    from tessella.functions.ids import type_of

    nodes = read_nodes(spark, path)
    known = nodes.join(namespaces.select("ns_id"), type_of(F.col("node")) == F.col("ns_id"), "left")
    bad = F.col("ns_id").isNull() | (F.col("weight") <= 0)
    freq = F.when(bad, F.raise_error(F.concat(F.lit("bad frequency of node "), F.col("node")))).otherwise(F.col("weight"))
    return known.select("node", freq.cast("double").alias("freq"))


def parse_parameters(rows: DataFrame) -> DataFrame:
    """tensor, kind, id (null for dense tensors), vec, from lines (value)"""
    p = _parts(rows)
    sparse = F.size("p") == 4
    vec = F.transform(F.split(F.get("p", F.size("p") - 1), ","), lambda x: x.cast("float"))
    return p.select(p.p[0].alias("tensor"), p.p[1].cast("int").alias("kind"), F.when(sparse, to_id(F.get("p", F.lit(2)))).alias("id"), vec.alias("vec"))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    return parse_parameters(lines(spark, path))


def parse_meta_paths(text: str) -> list[list[int]]:
    """1:2:3,1:4"""
    return [[int(t) for t in path.split(":")] for path in text.split(",") if path]


def read_meta_paths(spark: SparkSession, source: str) -> list[list[int]]:
    """From a file with one path a line, its types separated by blanks, or else from 1:2:3,1:4 itself; few by nature"""
    if re.fullmatch(r"[0-9:,]*", source):
        return parse_meta_paths(source)
    return [[int(t) for t in r.value.split()] for r in lines(spark, source).collect()]


def parse_samples(rows: DataFrame) -> DataFrame:
    """row, y, weight, pairs from lines (row, value) of `label[:weight] id[:value] ...`, where weights and values are 1 if not given.

    A line whose label, weight, id or value is malformed goes, as does one without features.
    """
    p = _parts(rows, "row")
    head = F.split(p.p[0], ":")

    def pair(part: Column) -> Column:
        kv = F.split(part, ":")
        value = F.when(F.size(kv) == 1, F.lit(1.0).cast("float")).when(F.size(kv) == 2, _number(F.get(kv, F.lit(1))))
        return F.struct(to_id(kv[0]).alias("id"), value.alias("w"))

    weight = F.when(F.size(head) == 1, F.lit(1.0).cast("float")).when(F.size(head) == 2, _number(F.get(head, F.lit(1))))
    pairs = F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), pair)
    found = _once(p, F.col("row"), _number(head[0]).alias("y"), weight.alias("weight"), pairs.alias("pairs"))
    good = F.forall("pairs", lambda x: x["id"].isNotNull() & x["w"].isNotNull())
    return found.filter(F.col("y").isNotNull() & F.col("weight").isNotNull() & (F.size("pairs") > 0) & good)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The same from files. row numbers the lines by file part and place, which a retried task gives again."""
    found = spark.read.option("recursiveFileLookup", True).text(path).select(F.monotonically_increasing_id().alias("row"), "value")
    return parse_samples(found.filter(F.length(F.trim("value")) > 0))


def parse_groups(text: str) -> list[tuple[int, int, int]]:
    """group:rows:columns,..."""
    return [tuple(int(x) for x in group.split(":")) for group in text.split(",") if group]


def format_pairs(rows: DataFrame, key: str = "node", pairs: str = "pairs") -> DataFrame:
    pair = F.transform(pairs, lambda x: F.concat(from_id(x["id"]), F.lit(":"), x["w"].cast("string")))
    return rows.select(F.concat_ws(" ", from_id(F.col(key)), F.array_join(pair, " ")).alias("value"))


def format_sequences(rows: DataFrame, nodes: str = "nodes") -> DataFrame:
    return rows.select(F.array_join(F.transform(nodes, from_id), " ").alias("value"))


def format_predictions(rows: DataFrame, node: str = "node", vec: str = "vec") -> DataFrame:
    return rows.select(F.concat_ws(" ", from_id(F.col(node)), F.array_join(F.col(vec).cast("array<string>"), " ")).alias("value"))


def write_lines(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Text under path, with Spark's success marker; an existing path raises."""
    (rows.repartition(files) if files else rows).write.mode("errorifexists").text(path)
