"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def l2_normalize(a: Column) -> Column:
    """A vector of zeros stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def softmax(a: Column) -> Column:
    exps = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda t, y: t + y))


def vector_sum(vec: str, dim: int, weight: Column | float = 1.0) -> Column:
    """Aggregate: the sum of weight times vec over a group, element by element. Combines before shuffles."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.array(*[F.sum(F.col(vec)[k].cast("double") * w) for k in range(dim)])
