"""Expressions on ``array<double>`` vectors (JVM-side higher-order functions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def l2_normalised(v: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean of a vector column, with map-side combine."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once per row, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)
