"""Vector expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products up to the shorter's end."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def normalise(a: Column) -> Column:
    """To length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def literal(v) -> Column:
    """A vector of the driver as an array of doubles."""
    return F.array(*(F.lit(float(x)) for x in v))
