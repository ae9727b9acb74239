"""Positions, bins and chromosome names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def methylated_count(coverage: Column, percent: Column) -> Column:
    """Reads that are methylated, rounded half to even."""
    return F.rint(coverage * percent / F.lit(100.0)).cast("bigint")


def canonical_position(chrom_start: Column, strand: Column) -> Column:
    """1-based position of the cytosine on the forward strand.

    A reverse-strand row reports the guanine one base further, so its 0-based
    start already is the wanted 1-based position.
    """
    return F.when(strand == "+", chrom_start + 1).otherwise(chrom_start).cast("bigint")


def bin_start(position: Column, width: int) -> Column:
    """Start of the bin that holds a 1-based position (floors below zero)."""
    offset = position.cast("bigint") - 1
    return offset - F.pmod(offset, F.lit(width).cast("bigint"))


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def normalize_chrom(name: Column) -> Column:
    """One spelling per chromosome: ``chr`` prefix, upper-case X and Y, M for mitochondria."""
    trimmed = F.btrim(name, F.lit(WHITESPACE))
    prefixed = F.lower(F.substring(trimmed, 1, 3)) == "chr"
    bare = F.when(prefixed, F.substring(trimmed, F.lit(4), F.length(trimmed))).otherwise(trimmed)
    return let(
        bare,
        lambda suffix: F.concat(
            F.lit("chr"),
            F.when(F.lower(suffix).isin("x", "y"), F.upper(suffix))
            .when(F.lower(suffix).isin("m", "mt"), F.lit("M"))
            .otherwise(suffix),
        ),
    )


def natural_chrom_key(chrom: Column) -> tuple[Column, Column]:
    """Sort key that puts chr2 before chr10 and the named chromosomes last."""
    suffix = F.regexp_replace(chrom, "^chr", "")
    numbered = suffix.rlike("^[0-9]+$")
    number = F.when(numbered, suffix.try_cast("bigint")).otherwise(F.lit(10_000).cast("bigint"))
    return number, F.when(numbered, F.lit("")).otherwise(suffix)
