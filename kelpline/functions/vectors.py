"""Expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - dot / norms; null where a norm is zero."""
    below = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return 1 - dot(a, b) / F.nullif(below, F.lit(0.0))


def usable(a: Column) -> Column:
    """Not null, without null or NaN, not all zero."""
    return a.isNotNull() & ~F.exists(a, lambda x: x.isNull() | F.isnan(x)) & F.exists(a, lambda x: x != 0)


def l2_normalised(a: Column) -> Column:
    """Unit length; a zero vector stays.  The norm is an argument of its own, so it is computed once per array."""
    lengths = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, lengths, lambda x, n: F.when(n > 0, x / n).otherwise(x.cast("double")))


def z_scored(a: Column, mean: Column, scale: Column) -> Column:
    centred = F.zip_with(a, mean, lambda x, m: x.cast("double") - m)
    return F.zip_with(centred, scale, lambda x, s: x / s)

