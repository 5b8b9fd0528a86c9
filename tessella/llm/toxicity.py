"""Toxic passages as maximal scoring segments, with extreme-value calibration.

A token's score is its log-odds between toxic and other labelled documents, less DRIFT. A document counts a token once, and
the counts have a Dirichlet prior in proportion to the sizes of both sides, so that a rare token is near to nought and a token
that no labelled document has is at nought. One linear scan of a text finds all its maximal scoring segments. By extreme-value theory a
text of n tokens that is not toxic has a segment of score s or more K n exp(-lambda s) times on average. A segment whose
expectation is SIGNIFICANT or less is a passage. A text's evidence is the sum of what its segments exceed their expectation
by, in nats, and a logistic curve over the evidence of labelled texts gives its probability.

lambda, K and the curve come from labelled texts that did not choose the scores: each half of them is scored by the counts of
the other half. Equal texts are in the same half.

Tasks look up the tokens in most labelled documents, LOOKED_UP at most; all other tokens are joined to their scores in Spark.
What tasks look up changes no score.

Defined results: a null or empty text has no segments and gets the score of no evidence, as does each text where no
document is labelled toxic, or none is not (then 0). Labels that are null are ignored; of several for a document the largest
counts. Rows that repeat are scored each. Of segments that touch, none has a prefix or suffix of score nought or less. Other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_small, settled, stored

TOKEN = re.compile(r"[^\W\d_]+")
#: The prior of a token: documents, and PRIOR times its share of all tokens; and the cost of a token in a segment.
DOCUMENTS, PRIOR, DRIFT = 10.0, 500.0, 0.75
#: The most tokens that tasks look up.
LOOKED_UP = 100_000
#: The expected number of such segments in a text that is not toxic, up to which one is a passage.
SIGNIFICANT = 0.05
#: Scores are whole multiples of 1 / UNITS, so that sums are exact and short.
UNITS = 256
#: Texts that are scanned at once.
ROWS = 256
#: Distinct tokens after which a task hands on its counts.
FLUSH = 200_000
#: Scores are summed up in steps of 1 / STEPS to find lambda.
STEPS = 64
#: Evidence beyond which the curve is flat, in nats.
MOST_EVIDENCE = 200.0

#: What scores a text: the counts of all labelled texts, or of those of one half.
ALL, FIRST, SECOND = "s_all", "s_0", "s_1"


@dataclass
class Model:
    known: dict[str, tuple[int, int, int]] = field(default_factory=dict)  # term: its log-odds, in units, by ALL, FIRST, SECOND
    rest: DataFrame | None = None  # term, s_all, s_0, s_1: the tokens that are not in known
    rate: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each half and label that have a term."""
    kinds = [(half, toxic) for half in (0, 1) for toxic in (0, 1)]
    counts = {kind: Counter() for kind in kinds}

    def rows() -> pa.RecordBatch:
        terms = list(set().union(*counts.values()))
        out = pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in counts.values()]], names=["term", *COUNTS]
        )
        for c in counts.values():
            c.clear()
        return out

    for batch in batches:
        for text, toxic, half in zip(*[batch.column(c).to_pylist() for c in ("text", "toxic", "half")], strict=True):
            counts[half, int(toxic > 0)].update(set(TOKEN.findall((text or "").lower())))
            if sum(map(len, counts.values())) > FLUSH:
                yield rows()
    yield rows()


#: Columns of counts: documents of half 0 and 1 that are not toxic (n) and toxic (t).
COUNTS = ["n_0", "t_0", "n_1", "t_1"]


def _labels(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and half of the documents with a label."""
    half = (F.crc32(F.coalesce("text", F.lit(""))) % 2).cast("int")
    return documents.select("doc_id", "text").join(broadcast_if_small(stored(_labels(labels), "labels")), "doc_id").withColumn("half", half)


def log_odds(clean: Column, toxic: Column, all_clean: float, all_toxic: float) -> Column:
    """In units, of a term in so many documents, where all terms together are in so many: shrunk, and nought where both are nought."""
    share = all_toxic / (all_clean + all_toxic)
    prior = DOCUMENTS + (clean + toxic) * (PRIOR / (all_clean + all_toxic))
    odds = F.log((toxic + prior * share) / (clean + prior * (1 - share))) - math.log(share / (1 - share))
    return F.round(odds * UNITS).cast("int")


def learn_terms(known: DataFrame) -> Model:
    """All tokens and their scores, and lambda, from labelled texts."""
    counted = known.select("text", "toxic", "half").mapInArrow(_count, "term string, n_0 long, t_0 long, n_1 long, t_1 long")
    counts = stored(counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS]), "terms")
    n_0, t_0, n_1, t_1 = (float(x or 0) for x in counts.agg(*[F.sum(c) for c in COUNTS]).first())
    if not n_0 + n_1 or not t_0 + t_1:
        return Model()
    both = log_odds(F.col("n_0") + F.col("n_1"), F.col("t_0") + F.col("t_1"), n_0 + n_1, t_0 + t_1)
    halves = [log_odds(F.col(n), F.col(t), a, b) if a and b else both for n, t, a, b in (("n_0", "t_0", n_0, t_0), ("n_1", "t_1", n_1, t_1))]
    scored = stored(counts.select("term", both.alias(ALL), halves[0].alias(FIRST), halves[1].alias(SECOND), *COUNTS), "scores")
    # Each half's clean tokens, by the scores that the other half gives them.
    seen = F.inline(F.array(F.struct(F.col(SECOND).alias("s"), F.col("n_0").alias("n")), F.struct(F.col(FIRST).alias("s"), F.col("n_1").alias("n"))))
    steps = scored.select(seen).groupBy(F.round(F.col("s") / UNITS * STEPS).alias("step")).agg(F.sum("n").alias("n")).filter("n > 0").collect()
    values = np.array([r.step / STEPS - DRIFT for r in steps])
    rate = _rate(values, np.array([float(r.n) for r in steps]))
    total = sum((F.col(c) for c in COUNTS), F.lit(0))
    often = stored(scored.orderBy(F.desc(total), "term").limit(LOOKED_UP).select("term", ALL, FIRST, SECOND), "often")
    model = Model({r[0]: (r[1], r[2], r[3]) for r in often.collect()}, rate=rate)
    if len(model.known) == LOOKED_UP:
        model.rest = stored(scored.join(F.broadcast(often.select("term")), "term", "left_anti").select("term", ALL, FIRST, SECOND), "rest")
    return model


def _rate(values: np.ndarray, n: np.ndarray) -> float:
    """lambda: where the mean of exp(lambda s) over clean tokens is 1. Their mean score is below nought."""
    share, low, high = n / n.sum(), 0.0, 1.0
    excess = lambda x: float(share @ np.exp(np.minimum(x * values, 500))) - 1
    while excess(high) < 0 and high < 100:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if excess(middle) > 0 else (middle, high)
    return max(low, 0.05)


def maximal_segments(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All maximal scoring segments, (first token, end, score), in time linear in hits.

    hits: the place, the sum of all scores before it, and the score of each token with a score above nought, in order. Each
    candidate keeps the sums before and after it, and which earlier one was the last to begin lower. A new one joins those back
    to that one if it ends higher; the candidates between need not be looked at, as they begin no lower than the one that skips
    them.
    """
    out: list[tuple[int, int, int, int, int]] = []  # start, end, sum before, sum after, the last that began lower
    for place, before, score in hits:
        start, low, high, j = place, before, before + score, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= high:
                break
            start, _, low, _, back = out[j]
            del out[j:]
            j = back
        out.append((start, place + 1, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in out]


#: DRIFT in units.
COST = round(DRIFT * UNITS)

SEGMENTS = "array<struct<start:int,end:int,score:double>>"
#: Of each text: the places, sums before and log-odds of its looked-up tokens that may begin a segment, and the tokens to be joined.
HITS = "n_tokens long, places array<int>, before array<int>, odds array<int>, terms array<string>, term_places array<int>, term_before array<int>"


def _lists(rows: list[list], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(chain.from_iterable(rows)), kind))


def _scan(known: list[dict[str, int]], halves: bool, joined: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                by = [known[1 - h] for h in batch.column("half").to_pylist()] if halves else [known[0]] * batch.num_rows
                out: list[list[list]] = [[] for _ in range(6)]
                sizes = []
                for text, odds_of in zip(batch.column("text").to_pylist(), by, strict=True):
                    row: list[list] = [[] for _ in range(6)]
                    places, before, odds, terms, term_places, term_before = row
                    total, tokens = 0, TOKEN.findall((text or "").lower())
                    for i, x in enumerate(map(odds_of.get, tokens)):
                        if x is None:
                            if joined:
                                terms.append(tokens[i])
                                term_places.append(i)
                                term_before.append(total)
                            total -= COST
                        else:
                            if x > COST:
                                places.append(i)
                                before.append(total)
                                odds.append(x)
                            total += x - COST
                    sizes.append(len(tokens))
                    for have, new in zip(out, row, strict=True):
                        have.append(new)
                arrays = [*[batch.column(c) for c in columns], pa.array(sizes, pa.int64())]
                if joined:
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                    arrays += [_lists(x, k) for x, k in zip(out, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *[c.split()[0] for c in HITS.split(", ")]])
                else:
                    rows = [[(i, low, x - COST) for i, low, x in zip(*hits, strict=True)] for hits in zip(*out[:3], strict=True)]
                    yield pa.RecordBatch.from_arrays([*arrays, _spans(rows)], names=[*columns, "n_tokens", "segments"])

    return run


def find_passages(documents: DataFrame, model: Model, carried: tuple[str, ...] = (), halves: bool = False) -> DataFrame:
    """doc_id, the carried columns, n_tokens, and all segments (start, end, score) of each document; start and end count its tokens.

    halves: a document of half 0 is scored by the counts of half 1, and the other way round.
    """
    kinds = {c: documents.schema[c].dataType.simpleString() for c in ("doc_id", *carried)}
    columns, given = list(kinds), ", ".join(f"{c} {k}" for c, k in kinds.items())
    used = [1, 2] if halves else [0]
    run = _scan([{t: v[k] for t, v in model.known.items()} for k in used], halves, model.rest is not None, columns)
    read = documents.select(*columns, "text")
    if model.rest is None:
        return read.mapInArrow(run, f"{given}, n_tokens long, segments {SEGMENTS}")
    read = stored(read.mapInArrow(run, f"{given}, {HITS}").withColumn("row", F.monotonically_increasing_id()), "hits")
    score = F.when(F.col("half") == 0, F.col(SECOND)).otherwise(F.col(FIRST)) if halves else F.col(ALL)
    site = F.arrays_zip(F.col("terms").alias("term"), F.col("term_places").alias("place"), F.col("term_before").alias("before"))
    sites = read.select("row", *(["half"] if halves else []), F.inline(site).alias("term", "place", "before"))
    found = sites.join(broadcast_if_small(model.rest), "term").select("row", F.struct("place", "before", score.alias("odds")).alias("x"))
    more = found.groupBy("row").agg(F.collect_list("x").alias("more"))
    both = read.drop("terms", "term_places", "term_before").join(more, "row", "left").select(
        *columns, "n_tokens", "places", "before", "odds", *[F.col(f"more.{c}").alias(f"more_{c}") for c in ("place", "before", "odds")]
    )
    return both.mapInArrow(_merged(columns), f"{given}, n_tokens long, segments {SEGMENTS}")


def _merged(columns: list[str]):
    """The segments of looked-up tokens and of joined ones, whose log-odds move all sums after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                lists = [batch.column(c).to_pylist() for c in ("places", "before", "odds", "more_place", "more_before", "more_odds")]
                rows = []
                for places, before, odds, *more in zip(*lists, strict=True):
                    every = list(zip(places, before, odds, repeat(0)))
                    if more[0]:
                        every = sorted([*every, *zip(*more, more[2], strict=True)])
                    moved, row = 0, []
                    for place, low, x, late in every:
                        if x > COST:
                            row.append((place, low + moved, x - COST))
                        moved += late
                    rows.append(row)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in columns], batch.column("n_tokens"), _spans(rows)], names=[*columns, "n_tokens", "segments"]
                )

    return run


def _spans(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    """An array of the segments of each row's hits."""
    found = [maximal_segments(hits) for hits in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = list(chain.from_iterable(found))
    parts = [pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)] + [pa.array([x[2] / UNITS for x in flat], pa.float64())]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=["start", "end", "score"]))


def with_expectation(passages: DataFrame, model: Model) -> DataFrame:
    """passages, where each segment has the number of such ones expected in a text of its length that is not toxic."""
    expected = lambda s: F.lit(model.k) * F.col("n_tokens") * F.exp(-model.rate * s["score"])
    return passages.withColumn(
        "segments", F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), expected(s).alias("expected")))
    )


def significant() -> Column:
    """Those segments (with their expectation) that are passages."""
    return F.filter("segments", lambda s: s["expected"] <= SIGNIFICANT)


def _evidence() -> Column:
    return F.aggregate("segments", F.lit(0.0), lambda t, s: t + F.greatest(-F.log(F.greatest(s["expected"], F.lit(1e-300))), F.lit(0.0)))


def calibrate(known: DataFrame, model: Model) -> Model:
    """Set K and the logistic curve from the passages of labelled texts (toxic), scored by the other half's counts."""
    if not model.known:
        return model
    known = known.withColumn("best", F.aggregate("segments", F.lit(0.0), lambda t, s: F.greatest(t, s["score"])))
    clean = known.filter("toxic = 0")
    middle = clean.filter("best > 0").select(F.percentile_approx("best", 0.5, 1000)).first()[0]
    if middle is not None:
        over, tokens = clean.agg(F.sum((F.col("best") >= middle).cast("long")), F.sum("n_tokens")).first()
        model.k = max(over / max(tokens * math.exp(-model.rate * middle), 1e-300), 1e-9)
    step = F.floor(F.least(_evidence(), F.lit(MOST_EVIDENCE)) * 4)
    rows = with_expectation(known, model).groupBy(step.alias("x")).agg(F.sum((F.col("toxic") > 0).cast("int")).alias("y"), F.count("*").alias("n")).collect()
    x, y, n = (np.array([float(r[c]) for r in rows]) for c in ("x", "y", "n"))
    x = np.log1p(x / 4)
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - n * p) - np.array([0, 1e-3]) * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-3
        w = w + np.linalg.solve(hess, grad)
    model.intercept, model.slope = float(w[0]), float(max(w[1], 0))
    return model


def score(passages: DataFrame, model: Model) -> DataFrame:
    """passages with the expectation of each segment and the probability of label 1."""
    out = with_expectation(passages, model)
    if not model.known:
        return out.withColumn("score", F.lit(0.0))
    curve = model.intercept + model.slope * F.log1p(F.least(_evidence(), F.lit(MOST_EVIDENCE)))
    return out.withColumn("score", 1 / (1 + F.exp(-curve)))


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """From the labelled ones among documents."""
    known = labelled(documents, labels)
    model = learn_terms(known)
    if not model.known:
        return model
    found = settled(documents.sparkSession, lambda: find_passages(known, model, ("toxic", "half"), halves=True), "calibration")
    return calibrate(found, model)


def toxicity(documents: DataFrame, labels: DataFrame, learnable: Column) -> DataFrame:
    """doc_id, n_tokens, segments and score of each of documents, learning only from labels whose doc_id is learnable."""
    model = learn(documents, labels.filter(learnable))
    return score(find_passages(documents, model), model)
