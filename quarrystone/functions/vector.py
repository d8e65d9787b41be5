"""Vector arithmetic on array columns, in double precision; NULL for vectors of different dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """NULL if a vector has no direction."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, dot, or euclidean as 1 / (1 + distance)."""
    if metric == "euclidean":
        return 1 / (1 + l2(a, b))
    return {"cosine": cosine, "dot": dot}[metric](a, b)


def normalize(a: Column) -> Column:
    """The vector with length 1; NULL if it has no direction. The norm is computed once for all parts."""
    unit = F.zip_with(a, F.array_repeat(F.nullif(norm(a), F.lit(0.0)), F.size(a)), lambda x, n: x.cast("double") / n)
    return F.when(F.forall(unit, lambda x: x.isNotNull()), unit)


def rounded(a: Column, digits: int) -> Column:
    """Each part rounded. As in SQL over doubles, a part below zero that rounds to zero is -0.0; Spark's round alone drops the sign."""
    return F.transform(a, lambda x: F.when((x < 0) & (F.round(x, digits) == 0), F.lit(-0.0)).otherwise(F.round(x, digits)))


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def zero(dim: int) -> Column:
    if dim < 1:
        raise ValueError("a vector has one part at least")
    return F.array_repeat(F.lit(0.0), dim)


def create(values: list[float]) -> Column:
    """A literal vector; not empty, all parts finite."""
    if not values or any(v != v or v in (float("inf"), float("-inf")) for v in values):
        raise ValueError("a vector needs finite parts")
    return F.array(*[F.lit(float(v)) for v in values])
