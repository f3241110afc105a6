"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics, and whether the larger value is the better one.
METRICS = {"cosine": True, "dot": True, "euclid": False, "manhattan": False}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def score(metric: str, a: Column, b: Column) -> Column:
    """Value of a metric between two arrays of one length."""
    if metric == "cosine":
        return dot(a, b) / (norm(a) * norm(b))
    if metric == "dot":
        return dot(a, b)
    if metric == "euclid":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    if metric == "manhattan":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    raise ValueError(f"unknown metric {metric!r}")


def valid(a: Column, dims: int) -> Column:
    """Not null, ``dims`` long, finite throughout."""
    return F.coalesce((F.size(a) == dims) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector is an error."""
    return F.when(norm(a) == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))
