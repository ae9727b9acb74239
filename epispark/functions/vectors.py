"""Vectors held as ``array<float>`` or ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_vector(vector: Column, weight: Column | None = None) -> Column:
    """Aggregate: element-wise mean, optionally weighted.

    The summarizer keeps one partial vector per key and task, so only partial
    vectors are shuffled, however many rows a key holds.
    """
    dense = array_to_vector(vector.cast("array<double>"))
    mean = Summarizer.mean(dense) if weight is None else Summarizer.mean(dense, weight)
    return vector_to_array(mean)


def zeros(width: int, dtype: str = "double") -> Column:
    return F.array_repeat(F.lit(0.0).cast(dtype), width)


def is_finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))


def all_finite(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: ~is_finite(x))
