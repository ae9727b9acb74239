"""Quality control of sequence windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.functions import sequence as S


def window_measures(windows: DataFrame, window: int) -> DataFrame:
    seq = F.col("sequence")
    return (
        windows.withColumn("sequence_length", F.length(seq))
        .withColumn("center_dinucleotide", S.center_dinucleotide(seq, window))
        .withColumn("unknown_base_count", S.unknown_count(seq))
        .withColumn("unsupported_base_count", S.unsupported_count(seq))
        .withColumn("unknown_fraction", S.unknown_count(seq) / F.lit(window))
    )


def window_status(windows: DataFrame, window: int, max_unknown_fraction: float) -> DataFrame:
    return windows.withColumn(
        "sequence_status", S.window_status(F.col("sequence"), window, max_unknown_fraction)
    )


def valid_windows(windows: DataFrame, window: int, max_unknown_fraction: float) -> DataFrame:
    """Windows that pass every check, with the two measures that are kept."""
    seq = F.col("sequence")
    return (
        windows.filter(S.window_status(seq, window, max_unknown_fraction) == S.VALID)
        .withColumn("sequence_length", F.length(seq))
        .withColumn("center_dinucleotide", S.center_dinucleotide(seq, window))
    )


def candidate_windows(windows: DataFrame, window: int, max_unknown_fraction: float) -> DataFrame:
    """The looser check of sampled windows: present, and not too many unknown bases."""
    seq = F.col("sequence")
    return windows.filter(
        seq.isNotNull() & (S.unknown_count(seq) / F.lit(window) <= max_unknown_fraction)
    )


def status_counts(checked: DataFrame) -> DataFrame:
    """How many windows were dropped, by reason."""
    return (
        checked.filter(F.col("sequence_status") != S.VALID)
        .groupBy("sequence_status")
        .agg(F.count("*").alias("dropped_count"))
    )


def invalid_windows(windows: DataFrame, window: int) -> DataFrame:
    return windows.filter(S.is_invalid_window(F.col("sequence"), window))
