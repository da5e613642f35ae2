"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """a divided by its length; a zero vector stays zero."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN where a vector is zero, which sorts last in ascending order."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.nullif(n, F.lit(0.0)))
