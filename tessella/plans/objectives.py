"""What models learn by: the gradients of scores and vectors, and the loss.

None makes pairs of all rows. A mean over all pairs is a product of sums, or a summary vector stands for all rows, or pairs are
those of a batch, whose size is a parameter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.networks import Network
from tessella.functions.vectors import dot
from tessella.plans.training import EPS


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def vector(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def cross_entropy(z: Column, y: Column) -> Column:
    """Of a score z and y, 0 or 1"""
    signed = F.when(y == 1, z).otherwise(-z)
    return F.greatest(-signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))


def pairwise_square(scores: DataFrame) -> DataFrame:
    """scores (y, z, ...) with loss, the mean of (1 - (p - n))**2 over all positives p and negatives n, and g, its gradient by z.

    Six sums give it. Without a positive or without a negative both are 0.
    """
    y, z = F.col("y"), F.col("z")
    parts = (y, 1 - y, y * (1 - z), y * (1 - z) * (1 - z), (1 - y) * z, (1 - y) * z * z)
    n_pos, n_neg, short, short2, neg, neg2 = (float(v or 0) for v in scores.agg(*[F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)]).first())
    if not n_pos or not n_neg:
        return scores.withColumns({"g": F.lit(0.0), "loss": F.lit(0.0)})
    loss = short2 / n_pos + 2 * (short / n_pos) * (neg / n_neg) + neg2 / n_neg
    g = F.when(y == 1, -2 / n_pos * (1 - z + neg / n_neg)).otherwise(2 / n_neg * (short / n_pos + z))
    return scores.withColumns({"g": g, "loss": F.lit(loss)})


def self_training(z: Column, upper: float = 0.69, lower: float = 0.31) -> tuple[Column, Column]:
    """Of a score: -p ln p where its probability p is at least upper or at most lower, else 0; and the gradient of that"""
    p = sigmoid(z)
    sure = (p >= upper) | (p <= lower)
    return F.when(sure, -p * F.log(p)).otherwise(0.0), F.when(sure, -(F.log(p) + 1) * p * (1 - p)).otherwise(0.0)


class Readout:
    """A layer over the sigmoid of the mean of vectors. Other vectors' inner products with it tell those of the graph from shuffled ones."""

    def __init__(self, size: int, seed: int):
        self.net, self.size = Network((size, size)), size
        self.flat, self.acc = self.net.initial(seed), np.zeros(self.net.count)

    def summary(self, own: DataFrame) -> tuple[list[np.ndarray], int]:
        """The layer's input and output for rows (h), and their number: all that leaves Spark is one vector of sums"""
        n, *sums = own.agg(F.count("*").alias("n"), *[F.sum(F.col("h")[k]).alias(f"s{k}") for k in range(self.size)]).first()
        mean = np.array([s or 0.0 for s in sums]) / max(n, 1)
        return self.net.outputs(self.flat, 1 / (1 + np.exp(-mean[None]))), n

    def scores(self, own: DataFrame, scored: DataFrame) -> DataFrame:
        """scored (h, ...) with z"""
        return scored.withColumn("z", dot(F.col("h"), vector(self.summary(own)[0][-1][0])))

    def pull(self, own: DataFrame, scored: list[DataFrame], rate: float) -> list[DataFrame]:
        """(row, d) for own (row, h) and for each of scored (row, h, y), and a step of the layer"""
        out, n = self.summary(own)
        at = vector(out[-1][0])
        scored = [s.withColumn("g", sigmoid(dot(F.col("h"), at)) - F.col("y")) for s in scored]
        back = np.zeros(self.size)
        for s in scored:
            sums = s.agg(*[F.sum(F.col("g") * F.col("h")[k]).alias(f"s{k}") for k in range(self.size)]).first()
            back += np.array([v or 0.0 for v in sums])
        grad, d_in = self.net.backward(self.flat, out, back[None])
        d_mean = d_in[0] * out[0][0] * (1 - out[0][0]) / max(n, 1)
        self.acc += grad**2
        self.flat = self.flat - rate * grad / np.sqrt(self.acc + EPS)
        return [own.select("row", vector(d_mean).alias("d")), *[s.select("row", F.transform(at, lambda v: v * F.col("g")).alias("d")) for s in scored]]


def contrast(left: np.ndarray, right: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The loss of each row, and the gradients by left and right of their sum.

    With cosines over tau: minus the logarithm of the sum of two shares, those of a row's own pair among its pairs with the
    other side and with the other rows of its side, for each of the sides.
    """
    norms = [np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (left, right)]
    u, v = left / norms[0], right / norms[1]
    across, own_u, own_v = np.exp(u @ v.T / tau), np.exp(u @ u.T / tau), np.exp(v @ v.T / tau)
    np.fill_diagonal(own_u, 0.0)
    np.fill_diagonal(own_v, 0.0)
    a, c = across.sum(1) + own_u.sum(1), across.sum(1) + own_v.sum(1)
    both = 1 / a + 1 / c
    loss = -np.log(np.diag(across)) - np.log(both)
    by_a, by_c = 1 / (a * a * both), 1 / (c * c * both)
    g = across * (by_a + by_c)[:, None] - np.eye(len(u))
    g_u, g_v = own_u * by_a[:, None], own_v * by_c[:, None]
    d_u, d_v = (g @ v + (g_u + g_u.T) @ u) / tau, (g.T @ u + (g_v + g_v.T) @ v) / tau
    back = [(d - m * (m * d).sum(1, keepdims=True)) / n for d, m, n in ((d_u, u, norms[0]), (d_v, v, norms[1]))]
    return loss, *back


def contrastive(rows: DataFrame, tau: float) -> DataFrame:
    """row, batch, loss, dl, dr from (row, batch, l, r), two views of each row. A batch is compared within itself, so its size bounds the memory."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("row")
        loss, d_left, d_right = contrast(np.stack(b["l"].to_list()), np.stack(b["r"].to_list()), tau)
        return pd.DataFrame({"row": b["row"], "batch": b["batch"], "loss": loss, "dl": list(d_left), "dr": list(d_right)})

    return rows.select("row", "batch", "l", "r").groupBy("batch").applyInPandas(run, "row long, batch long, loss double, dl array<double>, dr array<double>")


def normalized_pull(vec: str, d: str) -> Column:
    """The gradient by a vector, from that by the vector over its length; a vector of zeros has none"""
    v, g = F.col(vec), F.col(d)
    norm = F.sqrt(dot(v, v))
    along = dot(v, g) / (norm * norm)
    return F.when(norm > math.ulp(1.0), F.zip_with(g, v, lambda a, b: (a - b * along) / norm)).otherwise(F.transform(v, lambda _: F.lit(0.0)))
