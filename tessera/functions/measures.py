"""Arithmetic of measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    """a / b, or `none` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(none))


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of a share; 0 for no trials."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    nn = n.cast("double")
    inner = F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))
    return F.when(n > 0, (p + z * z / (2 * nn) - z * inner) / (1 + z * z / nn)).otherwise(0.0)


def f_one(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def nearest_rank(values: Column, share: float) -> Column:
    """Percentile at place round((n - 1) share) of the sorted values, halves to even."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.bround((F.size(ordered) - 1) * F.lit(share)).cast("int") + 1))


def floor_rank(values: Column, share: float) -> Column:
    """Percentile at place min(n - 1, floor(n share)) of the sorted values."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * F.lit(share)).cast("int")) + 1))


def percent_saved(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) * 100.0 / before).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in [0, 1]; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm)))
