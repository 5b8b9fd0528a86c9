"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit of the codewords, a binary classifier over hashed byte trigrams tells the
languages with a 1 from those with a 0: its weights are the trigrams' smoothed log-odds between the two sides, from counts
over all labelled texts. A text's margin for a bit is its mean weight times the number of its trigrams, or EVIDENCE if it has
more: neighbouring trigrams are not independent, so longer texts give no further evidence. Decoding
takes the codeword with the least loss, where a bit's loss is logistic in the margin times the bit, and counts by how well
that bit's classifier separates its sides. A text is ambiguous if the runner-up's loss is close.

A model with limits also rejects. As texts of unseen trigrams lean to the language with the fewest, one more bit tells all
languages from evenly spread trigrams, and its loss is added to the least one. A text is in no known language if this is
far beyond the losses of labelled texts of its length. Those are taken from a model of the other half of the labelled texts,
as for texts that were not learned.

Defined results: a null text, or one without a letter, is und with score 0 and is not ambiguous. Where no document has a
label, all are und. Ties go to the language that sorts first. Rows that repeat are scored each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import free_name
from tessella.llm.textarrays import LOWER, texts

BUCKETS = 1 << 15
SMOOTH = 0.5
#: Up to this many languages, every way to part them in two is a bit; beyond, BITS random ones are.
EXHAUSTIVE, BITS = 6, 63
#: Trigrams beyond which a longer text adds no evidence.
EVIDENCE = 40
#: Trigrams whose weights are summed at once.
CHUNK = 4096
#: Difference of the two best losses below which a text is ambiguous.
MARGIN = 1.0

#: A limit is this quantile of the labelled texts' losses, plus MARGIN. Fewer texts than LEAST give no limit.
QUANTILE, LEAST = 0.999, 100
#: Losses are counted in steps of 1 / STEPS, up to MOST.
STEPS, MOST = 64, 200

#: ASCII other than letters counts as a space.
NORMAL = np.where((np.arange(256) < 128) & ~((LOWER >= 97) & (LOWER <= 122)), 32, LOWER).astype(np.uint8)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte but a text's last two."""
    b = NORMAL[data].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for row, end, data, at in texts(batch.column("text")):
            for i in range(row, end):
                part = data[at[i - row] : at[i - row + 1]]
                if len(part) > 2:
                    have = counts.setdefault(langs[i], np.zeros(BUCKETS, dtype=np.int64))
                    have += np.bincount(_trigrams(part), minlength=BUCKETS)
    for lang, have in counts.items():
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(have[at])], names=["lang", "bucket", "n"]
        )


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """A row of -1 and 1 for each of n languages; no two columns are equal or opposite, none is constant."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=float).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, BITS))
        apart = (BITS - (code @ code.T)) / 2 + np.eye(n) * BITS
        if best is None or apart.min() > best[0]:
            best = apart.min(), code
    return best[1]


class Model:
    """langs, their codewords, weights (bucket, bit), each bit's share in the loss, and the weights of the bit for any language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        self.limits: np.ndarray | None = None  # the largest loss that is accepted, by _length
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), dtype=np.float32)
        self.share = np.ones(self.code.shape[1])
        rates = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
        self.any = np.log(rates.mean(axis=0) * BUCKETS).astype(np.float32) if langs else np.zeros(BUCKETS, dtype=np.float32)
        if len(langs) > 1:
            for bit in range(self.code.shape[1]):
                one, nought = (rates[self.code[:, bit] == side].mean(axis=0) for side in (1, -1))
                self.weights[:, bit] = np.log(one / nought)
                self.share[bit] = np.abs(one - nought).sum() / 2  # total variation between the sides
            self.share /= self.share.mean()

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """(text, language)"""
        return (np.logaddexp(0, -margins[:, None, :] * self.code) * self.share).sum(axis=2)

    def farness(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each text's least loss with that of the bit for any language."""
        margins = _margins(self.wide, data, at)
        return self.losses(margins[:, :-1]).min(axis=1) + np.logaddexp(0, -margins[:, -1])

    @property
    def wide(self) -> np.ndarray:
        """(bucket, bit), with the bit for any language last."""
        return np.column_stack([self.weights, self.any])


def _margins(weights: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(text, bit)"""
    margins = np.zeros((len(at) - 1, weights.shape[1]))
    for i in range(len(at) - 1):
        part = data[at[i] : at[i + 1]]
        if len(part) > 2:
            grams, sums = _trigrams(part), np.zeros(weights.shape[1])
            for k in range(0, len(grams), CHUNK):
                sums += weights[grams[k : k + CHUNK]].sum(axis=0, dtype=np.float64)
            margins[i] = sums / (len(part) - 2) * min(len(part) - 2, EVIDENCE)
    return margins


def _length(at: np.ndarray) -> np.ndarray:
    """The number of binary digits of each text's count of trigrams."""
    return np.frexp(np.maximum(np.diff(at) - 2, 0).astype(float))[1]


def _counted(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The sorted languages, and their counts (language, bucket)."""
    counts = labelled.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).collect()
    rows = sorted(by_lang, key=lambda r: r.lang)
    table = np.zeros((len(rows), BUCKETS))
    for k, r in enumerate(rows):
        table[k, r.buckets] = r.n
    return [r.lang for r in rows], table


def _labelled(documents: DataFrame) -> DataFrame:
    return documents.filter("text is not null and lang is not null")


def train(documents: DataFrame) -> Model:
    """From the text and lang of documents that have both. The driver gets one count for each language and bucket."""
    return Model(*_counted(_labelled(documents).select("text", "lang")))


def train_with_limits(documents: DataFrame) -> Model:
    """As train, with limits from all labelled documents. Equal texts are in the same half."""
    half = (F.crc32("text") % 2).cast("int")
    labelled = _labelled(documents)
    names, counts = _counted(labelled.select("text", F.concat(half.cast("string"), "lang").alias("lang")))
    langs = sorted({x[1:] for x in names})
    halves = np.zeros((2, len(langs), BUCKETS))
    for name, have in zip(names, counts, strict=True):
        halves[int(name[0]), langs.index(name[1:])] = have
    model = Model(langs, halves.sum(axis=0))
    if langs:
        others = [Model(langs, halves[1]), Model(langs, halves[0])]
        lettered = labelled.filter(_has_letter()).select("text", half.alias("half"))
        seen = lettered.mapInArrow(_loss_counts(others), "length int, step int, n long").groupBy("length", "step").agg(F.sum("n").alias("n"))
        model.limits = _limits([(r.length, r.step, r.n) for r in seen.collect()])
    return model


def _loss_counts(others: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((64, MOST * STEPS + 1), dtype=np.int64)
        for batch in batches:
            halves = np.array(batch.column("half").to_pylist(), dtype=int)
            for row, end, data, at in texts(batch.column("text")):
                length, half = _length(at), halves[row:end]
                for k, model in enumerate(others):
                    for i, loss in zip(np.flatnonzero(half == k), model.farness(data, at)[half == k], strict=True):
                        counts[length[i], int(min(loss, MOST) * STEPS)] += 1
        length, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(length.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[length, step])], names=["length", "step", "n"]
        )

    return run


def _limits(seen: list[tuple[int, int, int]]) -> np.ndarray | None:
    """By length, from the texts of that length; if they are fewer than LEAST, with those of the next shorter, then longer ones."""
    counts = np.zeros((64, MOST * STEPS + 1), dtype=np.int64)
    for length, step, n in seen:
        counts[length, step] = n
    if counts.sum() < LEAST:
        return None
    limits = np.full(64, np.inf)  # without a trigram there is no evidence
    for k in range(1, 64):
        have = np.zeros(MOST * STEPS + 1, dtype=np.int64)
        for other in [*range(k, -1, -1), *range(k + 1, 64)]:
            have += counts[other]
            if have.sum() >= LEAST:
                break
        step = int(np.searchsorted(np.cumsum(have), QUANTILE * have.sum()))
        limits[k] = (step + 1) / STEPS + MARGIN if step < MOST * STEPS else np.inf
    return limits


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("_letter").to_pylist()
            langs, scores, gaps = [], [], []
            for row, end, data, at in texts(batch.column("text")):
                if not model.langs:
                    langs += ["und"] * (end - row)
                    scores += [0.0] * (end - row)
                    gaps += [np.inf] * (end - row)
                    continue
                losses = model.losses(_margins(model.weights, data, at))
                order = np.argsort(losses, axis=1, kind="stable")
                best = np.take_along_axis(losses, order[:, :2], axis=1)
                odds = np.exp(best[:, :1] - losses).sum(axis=1)
                for i in range(end - row):
                    und = not letters[row + i]
                    langs.append("und" if und else model.langs[order[i, 0]])
                    scores.append(0.0 if und else float(1 / odds[i]))
                    gaps.append(np.inf if und or len(model.langs) < 2 else best[i, 1] - best[i, 0])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c not in ("text", "_letter")], pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64()), pa.array([bool(g < MARGIN) for g in gaps], pa.bool_())],
                names=[*[c for c in batch.schema.names if c not in ("text", "_letter")], "lang_pred", "score", "ambiguous"],
            )

    return run


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its share of the odds among all languages) and ambiguous for each of documents."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", _has_letter().alias("_letter")).mapInArrow(
        _predict(model), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    )


def keep_known(documents: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, without those that have no letter, are null, or lie beyond a limit.

    A model without limits, as where no language was learned, rejects no text with a letter.
    """
    names, letter = documents.columns, free_name("_letter", documents)
    keyed = documents.select("*", _has_letter().alias(letter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.array(batch.column(letter).to_pylist(), dtype=bool)
            if model.limits is not None:
                for row, end, data, at in texts(batch.column("text")):
                    known[row:end] &= model.farness(data, at) <= model.limits[_length(at)]
            yield batch.select(names).filter(pa.array(known, pa.bool_()))

    return keyed.mapInArrow(run, documents.schema)
