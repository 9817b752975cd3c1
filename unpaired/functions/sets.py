"""Predicates and measures of arrays taken as sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(x: Column, y: Column) -> Column:
    return F.arrays_overlap(x, y)


def disjoint(x: Column, y: Column) -> Column:
    return ~F.arrays_overlap(x, y)


def shared(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y)).cast("long")


def jaccard(x: Column, y: Column) -> Column:
    """Share of the union that is common; 0 for two empty sets."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def contains(x: Column, value: Column) -> Column:
    return F.array_contains(x, value)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def average(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def l1(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def min_max(a: Column, b: Column) -> Column:
    """Element-wise minima, then maxima: the same for (a, b) and (b, a)."""
    return F.concat(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


PAIR_OPERATORS = {"hadamard": hadamard, "avg": average, "concat": min_max, "l1": l1}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column) -> Column:
    """``a`` scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
