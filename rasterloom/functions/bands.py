"""Column expressions over a pixel's `bands` array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def valid(bands: Column) -> Column:
    """All bands are finite."""
    return F.forall(bands, finite)


def cleaned(bands: Column) -> Column:
    """NaN and infinite values become null."""
    return F.transform(bands, lambda x: F.when(finite(x), x))


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def distance32(a: Column, b: Column) -> Column:
    """Euclidean distance of two band arrays, rounded to float32."""
    return F.sqrt(squared_distance(a, b)).cast("float")


def bin_of(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """0 to n - 1 over [lo, hi], the ends clamped; null for a null value."""
    t = (x - lo) / (hi - lo)
    return F.when(x.isNull(), None).when(t <= 0, 0).when(t >= 1, n - 1).otherwise(F.least(F.lit(n - 1), F.floor(t * n))).cast("int")


def block(x: Column, size: int) -> Column:
    return F.floor(x / size).cast("int")
