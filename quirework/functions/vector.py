"""Column functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def certainty(cos: Column) -> Column:
    """The store's score: cosine moved from [-1, 1] to [0, 1]."""
    return (1 + cos) / 2


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_normalise(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def check(a: Column, dim: int) -> Column:
    """``missing``, ``dimension``, ``not_finite``, ``zero`` or ``ok``."""
    return (
        F.when(a.isNull(), "missing")
        .when(F.size(a) != dim, "dimension")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(F.forall(a, lambda x: x == 0), "zero")
        .otherwise("ok")
    )
