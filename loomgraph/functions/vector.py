"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def fit(a: Column, n: int) -> Column:
    """First n components, scaled to unit length; null for short or zero vectors."""
    cut = F.slice(a.cast("array<double>"), 1, n)
    return F.when((F.size(a) >= n) & (norm(cut) > 0), F.transform(cut, lambda x: x / norm(cut)))
