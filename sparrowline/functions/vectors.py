"""Distances between vector columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; a zero vector is at distance one from everything."""
    def dot(x, y):
        return _sum(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
