"""Vectors held as arrays: finiteness, norms, cosines, norm-based operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_finite(v: Column) -> Column:
    """False for a null vector or one with a null, NaN or infinite entry."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(v, bad), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def is_close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-6) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)
