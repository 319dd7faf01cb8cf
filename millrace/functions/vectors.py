"""Vectors as array columns, folded from the left in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def blend(full: Column, title: Column, alpha: float | Column) -> Column:
    """(1 - alpha) full + alpha title; a missing title counts 0."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return (1 - a) * full + a * F.coalesce(title, F.lit(0.0))
