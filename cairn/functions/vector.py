"""Vector columns: norm, dot product and clamped cosine, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def clamp(score: Column) -> Column:
    """To [0, 1]; null and NaN become 0."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(score, F.lit(0.0)))), F.lit(0.0))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    return clamp(F.when((norm_a > 0) & (norm_b > 0), dot(a, b) / (norm_a * norm_b)).otherwise(0.0))
