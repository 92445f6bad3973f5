"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product; the longer vector's surplus counts as zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero, so that its cosine with anything is 0."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(F.transform(a, lambda x: F.lit(0.0)))
