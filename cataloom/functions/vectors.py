"""Vector expressions over array columns, evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two double vectors with known norms; 0 where either is all zero."""
    scale = norm_a * norm_b
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))
