"""Vector functions on arrays of numbers, in the JVM. Sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null if the lengths differ or an element is null."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """Of length one; the zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(_double(a), lambda x: x / size)).otherwise(_double(a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is the zero vector, null if one is null or the lengths differ."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).when(both == 0, F.lit(0.0))
