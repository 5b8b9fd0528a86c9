"""64-bit ids: the top 16 bits are the type (namespace, feature group), the low 48 the id within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the id format and of its text files.
TYPE_BITS, SUB_MASK = 48, (1 << 48) - 1
LEAST_WEIGHT, MOST_WEIGHT = -10.0, 10.0
PARAMETER_SLOTS = 9973


def encode_id(kind: Column, sub: Column) -> Column:
    return F.shiftleft(kind.cast("long"), TYPE_BITS).bitwiseOR(sub.cast("long").bitwiseAND(F.lit(SUB_MASK)))


def type_of(node: Column) -> Column:
    return F.shiftrightunsigned(node, TYPE_BITS).cast("int")


def sub_of(node: Column) -> Column:
    return node.bitwiseAND(F.lit(SUB_MASK))


def shard_of(node: Column, shards: int) -> Column:
    """Ids from 2**63 on are negative here; their shard is that of the unsigned number."""
    wrap = F.lit((1 << 64) % shards)
    return F.when(node >= 0, node % shards).otherwise(F.pmod(F.pmod(node, F.lit(shards)) + wrap, F.lit(shards))).cast("int")


def parameter_shard_of(node: Column, shards: int) -> Column:
    return shard_of(node, PARAMETER_SLOTS) % shards


def weight_in_range(w: Column) -> Column:
    return w.between(LEAST_WEIGHT, MOST_WEIGHT)


def unsigned_order(node: Column) -> Column:
    """Sorts as the unsigned ids do."""
    return node.bitwiseXOR(F.lit(-(1 << 63)))


def types_in(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """The distinct types of nodes (node), the smallest `most` of them."""
    kinds = nodes.select(type_of(F.col("node")).alias("type")).distinct()
    return kinds if most is None else kinds.orderBy("type").limit(most)


def split_by_type(nodes: DataFrame, user: int, item: int) -> tuple[DataFrame, DataFrame]:
    """User nodes and item nodes; others go."""
    kind = type_of(F.col("node"))
    return nodes.filter(kind == user), nodes.filter(kind == item)
