"""What the models are made of: tables of vectors looked up by joins, networks run by partition, and synchronous steps.

A table (id, vec, acc) stays distributed: rows sum the vectors of their features, and the gradients of an id are summed before
the shuffle. The parameters of a network are one vector, bounded by its layers, which the driver holds; each partition
returns one gradient, and Spark sums these by position. Steps are Adagrad over sums, so they do not depend on the number of
rows. AQE splits joins at frequent features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.lineage import cut
from tessella.functions.rng import uniform
from tessella.functions.vectors import vector_sum

EPS = 1e-6


def new_table(ids: DataFrame, dim: int, seed: int) -> DataFrame:
    """id, vec, acc for the distinct values of the first column"""
    ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    vec = F.array(*[(uniform(seed, "id", F.lit(k)) - 0.5) / dim for k in range(dim)])
    return ids.select("id", vec.alias("vec"), F.array_repeat(F.lit(0.0), dim).alias("acc"))


def pool(rows: DataFrame, features: DataFrame, table: DataFrame, dim: int, groups: int = 1) -> DataFrame:
    """row, x: for each group, the sum of v times the vector of fid; features are (row, fid, grp, v). Rows without features are zeros."""
    found = features.join(table.select(F.col("id").alias("fid"), "vec"), "fid")
    sums = found.groupBy("row", "grp").agg(vector_sum("vec", dim, F.col("v")).alias("vec"))
    by_row = sums.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("grp", "vec"))).alias("by_grp"))  # at most `groups` entries
    zeros = F.array_repeat(F.lit(0.0), dim)
    cells = F.flatten(F.array(*[F.coalesce(F.try_element_at("by_grp", F.lit(g)), zeros) for g in range(groups)]))
    return rows.select("row").join(by_row, "row", "left").select("row", cells.alias("x"))


def scatter(grads: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """id, g: what pool hands back to the table, from grads (row, dx)"""
    found = features.join(grads.select("row", "dx"), "row")
    cells = [F.sum(F.col("v") * F.get("dx", (F.col("grp") * dim + k).cast("int"))) for k in range(dim)]
    return found.groupBy(F.col("fid").alias("id")).agg(F.array(*cells).alias("g"))


def update(table: DataFrame, grads: DataFrame, rate: float) -> DataFrame:
    """The table after a step, checkpointed; ids without a gradient stay."""
    acc = F.zip_with("acc", "g", lambda a, g: a + g * g)
    moved = table.join(grads, "id", "left").withColumn("acc", F.when(F.col("g").isNull(), F.col("acc")).otherwise(acc))
    by = F.zip_with("g", "acc", lambda g, a: rate * g / F.sqrt(a + EPS))
    vec = F.when(F.col("g").isNull(), F.col("vec")).otherwise(F.zip_with("vec", by, lambda v, b: v - b))
    return cut(moved.select("id", vec.alias("vec"), "acc"))


class Dense:
    """A network with its parameters"""

    def __init__(self, net, seed: int):
        self.net, self.flat, self.acc = net, net.initial(seed), np.zeros(net.count)

    def forward(self, rows: DataFrame) -> DataFrame:
        """row, x, h"""
        net, flat = self.net, self.flat

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(h=list(net.outputs(flat, np.stack(b["x"].to_list()))[-1]))

        return rows.select("row", "x").mapInPandas(run, "row long, x array<double>, h array<double>")

    def backward(self, rows: DataFrame) -> DataFrame:
        """From (row, x, d): row, dx; checkpointed. Rows with dense instead hold a partition's gradient of the parameters."""
        net, flat = self.net, self.flat

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(net.count)
            for b in batches:
                if len(b):
                    out = net.outputs(flat, np.stack(b["x"].to_list()))
                    grad, dx = net.backward(flat, out, np.stack(b["d"].to_list()))
                    total += grad
                    yield pd.DataFrame({"row": b["row"], "dx": list(dx), "dense": None})
            yield pd.DataFrame({"row": [None], "dx": [None], "dense": [total]})

        return cut(rows.select("row", "x", "d").mapInPandas(run, "row long, dx array<double>, dense array<double>"))

    def step(self, grads: DataFrame, rate: float) -> None:
        cells = grads.filter("dense is not null").select(F.posexplode("dense").alias("pos", "g")).groupBy("pos").agg(F.sum("g").alias("g"))
        grad = np.zeros(self.net.count)
        for r in cells.collect():  # as many as the network has parameters
            grad[r.pos] = r.g
        self.acc += grad**2
        self.flat = self.flat - rate * grad / np.sqrt(self.acc + EPS)
