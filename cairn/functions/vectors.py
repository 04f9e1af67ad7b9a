"""Vector expressions over array columns, in double precision. All of them stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x * x)))


def l2_normalize(v: Column, least: float = 1e-8) -> Column:
    """v by its norm; a zero vector stays zero."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(least)))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot of unit vectors, clipped to [-1, 1]; vectors of no length are at distance 1."""
    d = dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d))


def missing_as_null(c: Column) -> Column:
    """NaN and infinities become null: pandas-style missing values must not spread through aggregates."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
