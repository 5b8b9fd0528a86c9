"""Evaluation of embeddings and predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and items, about, that a task compares at once, and pairs of which it holds the products: bound what a task holds.
QUERY_BLOCK, ITEM_BLOCK, PAIRS = 8192, 16384, 1 << 19


def top_inner_products(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """q, item, score, rank: the k items of the largest inner product for each query, smaller ids first where equal.

    Exact: each block of queries meets each block of items in one task, which keeps k items a query. A score is null, and last,
    if a vector is null or has a null, or if their lengths differ.
    """
    nq, ni = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-items.count() // ITEM_BLOCK))
    q, item = queries.toDF("id", "vec"), items.toDF("id", "vec")
    types = q.schema["id"].dataType.simpleString(), item.schema["id"].dataType.simpleString()

    def placed(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        spread = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return spread.select("_qb", "_ib", F.col("id"), F.col("vec").cast("array<double>").alias("vec"))

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, k)

    left, right = placed(q, "_qb", nq, "_ib", ni).groupBy("_qb", "_ib"), placed(item, "_ib", ni, "_qb", nq).groupBy("_qb", "_ib")
    near = left.cogroup(right).applyInArrow(best, f"q {types[0]}, item {types[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(queries: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """q, item, score: the k best items of each query at least"""
    items = items.take(pa.compute.sort_indices(items, sort_keys=[("id", "ascending")], null_placement="at_start"))
    q_len, q_rows = _dense(queries)
    i_len, i_rows = _dense(items)
    out = []
    for n in np.unique(q_len):
        mine = np.flatnonzero(q_len == n)
        with_score = np.flatnonzero(i_len == n) if n >= 0 else np.empty(0, np.int64)
        for a, b, score in _scored(q_rows[n], i_rows[n], k) if len(with_score) else ():
            out.append((mine[a], with_score[b], score))
        without = np.setdiff1d(np.arange(len(i_len)), with_score)[: max(0, k - len(with_score))]
        out.append((np.repeat(mine, len(without)), np.tile(without, len(mine)), pa.nulls(len(mine) * len(without), pa.float64())))
    scores = pa.chunked_array([pa.array(x[2], pa.float64()) for x in out], pa.float64())
    a, b = (np.concatenate([np.empty(0, np.int64), *[x[i] for x in out]]) for i in (0, 1))
    return pa.table({"q": queries["id"].take(pa.array(a)), "item": items["id"].take(pa.array(b)), "score": scores})


def _dense(rows: pa.Table) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The vectors' lengths, -1 for one that is null or has a null, and for each length a matrix of the vectors in order"""
    vec = rows["vec"].combine_chunks()
    vec = vec if isinstance(vec, pa.ListArray) else pa.concat_arrays(vec.chunks) if vec.num_chunks else pa.array([], rows["vec"].type)
    lengths = pa.compute.fill_null(pa.compute.list_value_length(vec), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    holes = pa.compute.list_parent_indices(vec).filter(pa.compute.is_null(pa.compute.list_flatten(vec)))
    lengths[np.unique(holes.to_numpy(zero_copy_only=False))] = -1
    found = {}
    for n in np.unique(lengths[lengths >= 0]):
        some = vec.take(pa.array(np.flatnonzero(lengths == n)))
        found[n] = pa.compute.list_flatten(some).to_numpy(zero_copy_only=False).astype(float).reshape(len(some), n)
    return lengths, found


def _scored(queries: np.ndarray, items: np.ndarray, k: int):
    """Places of queries and items, and scores, of the k best items a query, smaller places first where equal.

    Matrix products choose the candidates, with room for rounding; their scores are then summed in order, so that equal vectors
    have equal scores wherever they lie.
    """
    _, group = np.unique(items, axis=0, return_inverse=True)  # of equal vectors, the first k are enough
    order = np.argsort(group.ravel(), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(group.ravel()))])
    kept = np.sort(order[np.arange(len(order)) - starts[group.ravel()[order]] < k])
    items = items[kept]
    n, dim = items.shape
    with np.errstate(all="ignore"):
        room = 4 * (dim + 2) * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(items, axis=1).max(initial=0)
        room = np.where(np.isnan(room), np.inf, room)
        step = max(1, PAIRS // n)
        for start in range(0, len(queries), step):
            part = queries[start : start + step]
            products = part @ items.T
            least = np.partition(products, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), -np.inf)
            close = products >= (least - room[start : start + step])[:, None]
            close[~np.isfinite(products).all(axis=1)] = True
            a, b = np.nonzero(close)
            score = np.zeros(len(a))
            for d in range(dim):
                score += part[a, d] * items[b, d]
            order = np.lexsort((b, -score, ~np.isnan(score), a))  # no number is above all numbers
            a, b, score = a[order], b[order], score[order]
            first = np.searchsorted(a, a, side="left")
            best = np.arange(len(a)) - first < k
            yield a[best] + start, kept[b[best]], score[best]


def hit_rate(queries: DataFrame, items: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """k, hit, total, rate: how many queries have their own item (q, item) among the k best, of those whose item is known"""
    known = own.join(items.select(items.columns[0]).toDF("item"), "item", "left_semi")
    best = top_inner_products(queries.join(known.select(F.col("q").alias(queries.columns[0])), queries.columns[0], "left_semi"), items, k)
    hits = known.join(best.select("q", "item", F.lit(1).alias("hit")), ["q", "item"], "left")
    return hits.agg(F.lit(k).alias("k"), F.count("hit").alias("hit"), F.count("*").alias("total")).withColumn("rate", F.col("hit") / F.col("total"))


def f1(rows: DataFrame) -> DataFrame:
    """micro_f1 and macro_f1 of (label, y, predicted), both 0 or 1"""
    per = rows.groupBy("label").agg(
        F.sum(F.col("y") * F.col("predicted")).alias("tp"), F.sum("predicted").alias("p"), F.sum("y").alias("t")
    )
    one = F.when(F.col("p") + F.col("t") > 0, 2 * F.col("tp") / (F.col("p") + F.col("t"))).otherwise(0.0)
    return per.agg((2 * F.sum("tp") / (F.sum("p") + F.sum("t"))).alias("micro_f1"), F.avg(one).alias("macro_f1"))


def top_k_labels(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """node, label, y, predicted: each node gets as many labels as it has, those of the largest scores (node, label, score)"""
    have = truth.groupBy("node").agg(F.count("*").alias("k"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "label"))
    ranked = scores.join(have, "node").withColumn("predicted", (rank <= F.col("k")).cast("int"))
    marked = ranked.join(truth.select("node", "label", F.lit(1).alias("y")), ["node", "label"], "left")
    return marked.select("node", "label", F.coalesce("y", F.lit(0)).alias("y"), "predicted")


def auc(rows: DataFrame) -> DataFrame:
    """auc of (score, y), where ties count half. Scores are counted first, so the order is over distinct scores."""
    per = rows.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("won", F.col("p") * (below + F.col("n") / 2)).agg((F.sum("won") / (F.sum("p") * F.sum("n"))).alias("auc"))
