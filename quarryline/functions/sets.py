"""Similarity of sets and vectors, and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_empty(a: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(a, F.array().cast(kind))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero or unequally long vectors."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    good = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.coalesce(F.when(good, dot(a, b) / F.when(good, norm)), F.lit(0.0))


def compact(*items: Column) -> Column:
    """An array of those that are not null."""
    return F.array_compact(F.array(*items))


def first_or(a: Column, default: str) -> Column:
    return F.coalesce(F.get(a, F.lit(0)), F.lit(default))


def union_sets(a: str) -> Column:
    """Aggregate: the distinct elements of all arrays, in order."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(a))))
