"""Columns over dense vectors (arrays), sparse vectors (maps) and sets (arrays). Arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zeros or the lengths differ."""
    norms = magnitude(a) * magnitude(b)
    return F.when(F.size(a) != F.size(b), 0.0).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Of maps of counts: 1 if both are empty, 0 if one is."""
    products = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0))))
    norms = magnitude(F.map_values(a)) * magnitude(F.map_values(b))
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b | (norms == 0), 0.0).otherwise(_sum(products) / norms)


def jaccard(a: Column, b: Column) -> Column:
    """Of sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, 1.0).otherwise(both / F.when(either == 0, 1).otherwise(either))


def normalised_difference(a: Column, b: Column, most: float) -> Column:
    """|a - b| / most; with most = 0, 0 for equal values and 1 for others. May go beyond 1."""
    if most == 0:
        return F.when(a == b, 0.0).otherwise(1.0)
    return F.abs(a - b).cast("double") / F.lit(float(most))


def alike(a: Column, b: Column, most: float) -> Column:
    return 1 - normalised_difference(a, b, most)
