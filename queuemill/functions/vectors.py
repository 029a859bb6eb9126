"""Array-of-double vectors, row by row inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once per row, also where `use` loops over it."""
    return F.transform(F.array(value), use)[0]


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def unit(vector: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    by_length = lambda pair: F.transform(pair["v"], lambda x: x / pair["n"])
    with_length = lambda v: F.struct(v.alias("v"), F.greatest(norm(v), F.lit(1e-9)).alias("n"))
    return bind(bind(vector, with_length), by_length)


def standardised(vector: Column, mean: Column, std: Column) -> Column:
    centred = F.zip_with(vector, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / s)


def scaled(vector: Column, factor) -> Column:
    return F.transform(vector, lambda x: x * factor)


def argmax(scores: Column) -> Column:
    """Lowest index among the largest values, counted from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")
