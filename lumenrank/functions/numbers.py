"""Null-aware arithmetic. A missing value is not zero: it leaves means and scores out of account."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def r3(x: Column) -> Column:
    """Rounded half up to three decimals."""
    return F.floor(x * 1000 + 0.5) / F.lit(1000.0)


def r1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / F.lit(10.0)


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))


def ratio3(part: Column, whole: Column) -> Column:
    """part / whole to three decimals from integers, exact at the half; null if whole is 0."""
    n, d = part.cast("long"), F.nullif(whole.cast("long"), F.lit(0).cast("long"))
    return F.floor((n * 2000 + d) / (d * 2)) / F.lit(1000.0)


def weighted(parts: Iterable[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are known, each clamped to 0..1; null if none is."""
    parts = list(parts)
    top = bottom = F.lit(0.0)
    for value, weight in parts:
        known = value.isNotNull() & ~F.isnan(value.cast("double"))
        top = top + F.when(known, clamp01(value) * F.lit(float(weight))).otherwise(0.0)
        bottom = bottom + F.when(known, F.lit(float(weight))).otherwise(0.0)
    return r3(top / F.nullif(bottom, F.lit(0.0)))


def nearest_rank(values: Column, p: float) -> Column:
    """Element at round((n-1) * p) of an array in order; null for an empty one."""
    n = F.size(values)
    return F.when(n > 0, F.get(F.sort_array(values), F.floor((n - 1) * F.lit(p) + 0.5).cast("int")))


def confidence_level(x: Column) -> Column:
    return F.when(x >= 0.6, "high").when(x >= 0.3, "medium").otherwise("low")


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(share, low, high) of k successes in n: the 95 % score interval; zeros for n = 0."""
    d = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / d
    base = 1 + F.lit(z * z) / d
    mid = (p + F.lit(z * z) / (d * 2)) / base
    half = F.lit(z) * F.sqrt(p * (1 - p) / d + F.lit(z * z) / (d * d * 4)) / base
    zero = F.lit(0.0)
    return F.struct(
        F.coalesce(r3(p), zero).alias("share"),
        F.when(n > 0, r3(F.greatest(zero, mid - half))).otherwise(zero).alias("low"),
        F.when(n > 0, r3(F.least(F.lit(1.0), mid + half))).otherwise(zero).alias("high"),
    )
