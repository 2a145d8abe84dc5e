"""Vector functions over arrays of numbers, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def dot(a: Column, b: Column) -> Column:
    """F4."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """retrieval's cosine, with a small number in each denominator."""
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def plain_cosine(a: Column, b: Column) -> Column:
    """evaluation's cosine: 0 where a norm is 0."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)
