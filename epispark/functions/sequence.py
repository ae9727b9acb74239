"""Windows of bases: quality measures and integer codes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from epispark.functions.coordinates import WHITESPACE, let
from epispark.params import BASE_ORDER, UNKNOWN_BASE_CODE, UNKNOWN_DINUCLEOTIDE_CODE

# The outcomes of the window check, in the order they are tried.
MISSING = "Missing chromosome or boundary sequence"
BAD_LENGTH = "Incorrect sequence length"
UNSUPPORTED = "Unsupported reference base"
BAD_CENTER = "Center is not CG"
TOO_UNKNOWN = "Unknown fraction above threshold"
VALID = "Valid"
FAILURES = (MISSING, BAD_LENGTH, UNSUPPORTED, BAD_CENTER, TOO_UNKNOWN)


def count_outside(sequence: Column, alphabet: str) -> Column:
    """How many characters are not in ``alphabet``."""
    return F.length(F.translate(sequence, alphabet, ""))


def center_dinucleotide(sequence: Column, window: int) -> Column:
    return F.substring(sequence, window // 2 + 1, 2)


def unknown_count(sequence: Column) -> Column:
    return count_outside(sequence, "ACGT")


def unsupported_count(sequence: Column) -> Column:
    return count_outside(sequence, "ACGTN")


def window_status(sequence: Column, window: int, max_unknown_fraction: float) -> Column:
    """First failed check of a window, or ``Valid``."""

    def status(text: Column) -> Column:
        return (
            F.when(text.isNull(), MISSING)
            .when(F.length(text) != window, BAD_LENGTH)
            .when(unsupported_count(text) > 0, UNSUPPORTED)
            .when(center_dinucleotide(text, window) != "CG", BAD_CENTER)
            .when(unknown_count(text) / F.lit(window) > max_unknown_fraction, TOO_UNKNOWN)
            .otherwise(VALID)
        )

    # A filter on the status is pushed below the step that cuts the window out; bound
    # once, the window is not cut again for every test.
    return let(sequence, status)


def clean(sequence: Column) -> Column:
    return F.upper(F.btrim(sequence, F.lit(WHITESPACE)))


def base_codes(sequence: Column) -> Column:
    """A, C, G, T as 0 to 3 and anything else as 4."""
    place = F.lit(BASE_ORDER)
    # instr is 0 for an unknown base and 1 to 4 for a known one.
    return F.transform(
        F.split(clean(sequence), ""),
        lambda base: F.pmod(F.instr(place, base) + UNKNOWN_BASE_CODE, F.lit(UNKNOWN_BASE_CODE + 1)).cast(
            "smallint"
        ),
    )


def pair_codes(codes: Column) -> Column:
    """Neighbouring base codes as one code: AA is 0, TT is 15, any unknown gives 255."""
    bases = len(BASE_ORDER)

    def pair(a: Column, i: Column) -> Column:
        b = F.get(codes, i + 1)
        return (
            F.when((a >= bases) | (b >= bases), UNKNOWN_DINUCLEOTIDE_CODE)
            .otherwise(a * bases + b)
            .cast("smallint")
        )

    return F.transform(F.slice(codes, F.lit(1), F.size(codes) - 1), pair)


def dinucleotide_codes(sequence: Column) -> Column:
    return let(base_codes(sequence), pair_codes)


def one_hot(codes: Column) -> Column:
    """One row per base over the base codes; an unknown base is a zero column."""

    def row(known: Column, base: int) -> Column:
        return F.transform(known, lambda c: (c == base).cast("float"))

    return let(codes, lambda known: F.array(*[row(known, b) for b in range(len(BASE_ORDER))]))


def property_matrix(codes: Column, properties: Sequence[Sequence[float] | None]) -> Column:
    """One row per property over the pair codes; an unknown pair is a zero column.

    ``properties`` has one row of values per code, so it is a fixed-size literal. A
    pair whose row is None counts as unknown.
    """
    zero = F.lit(0.0).cast("float")
    width = next(len(of_code) for of_code in properties if of_code is not None)

    def row(codes: Column, j: int) -> Column:
        listed = [F.lit(0.0 if of_code is None else float(of_code[j])) for of_code in properties]
        values = F.array(*listed).cast("array<float>")
        return F.transform(codes, lambda c: F.coalesce(F.get(values, c), zero))

    return let(codes, lambda known: F.array(*[row(known, j) for j in range(width)]))


def expand_codes(codes: Column, properties: Sequence[Sequence[float] | None]) -> Column:
    """``property_matrix`` of a stored column of pair codes, by an Arrow function.

    All codes of a batch are looked up at once in the flat values of the list column; no code
    becomes an object of its own. ``codes`` must be a column of a table: Spark hands no array
    expression with lambdas on to such a function.
    """
    width = next(len(of_code) for of_code in properties if of_code is not None)
    known = np.array([[0.0] * width if of_code is None else of_code for of_code in properties], np.float32)
    table = np.vstack([known, np.zeros((1, width), np.float32)])

    @F.arrow_udf("array<array<float>>")
    def expand(batch: pa.Array) -> pa.Array:
        flat = batch.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        index = np.where((flat >= 0) & (flat < len(known)), flat, len(known)).astype(np.int64)
        rows = np.repeat(sizes, width)  # lengths of the property rows
        ends = np.cumsum(rows)
        first = np.repeat(np.cumsum(sizes) - sizes, width)
        place = np.arange(len(index) * width) - np.repeat(ends - rows - first, rows)
        values = table[index[place], np.repeat(np.tile(np.arange(width), len(sizes)), rows)]
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
        outer = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * width)
        return pa.ListArray.from_arrays(outer, inner, mask=pc.is_null(batch))

    return expand(codes)


def checked_codes(
    sequence: Column,
    window: int,
    properties: Sequence[Sequence[float] | None],
    unknown_strategy: str = "zero",
) -> Column:
    """Pair codes of a window; a wrong length or letter fails the query.

    With ``unknown_strategy="error"`` a pair of known bases that the table lacks fails it
    too; a pair with an N is always allowed.
    """
    if unknown_strategy not in ("zero", "error"):
        raise ValueError("unknown_strategy must be 'zero' or 'error'")
    invalid = F.concat(F.lit("invalid window: "), sequence)
    codes = dinucleotide_codes(sequence)
    kind = "array<smallint>"
    lacking = [code for code, of_code in enumerate(properties) if of_code is None]
    if unknown_strategy == "error" and lacking:
        unlisted = F.raise_error(F.concat(F.lit("a pair has no properties: "), sequence)).cast(kind)
        codes = let(
            codes,
            lambda known: F.when(F.exists(known, lambda c: c.isin(*lacking)), unlisted).otherwise(known),
        )
    return F.when(is_invalid_window(sequence, window), F.raise_error(invalid).cast(kind)).otherwise(codes)


def is_invalid_window(sequence: Column, window: int) -> Column:
    """Missing, of a wrong length, or with a letter outside A, C, G, T, N."""
    wrong = (F.length(clean(sequence)) != window) | (count_outside(clean(sequence), "ACGTN") > 0)
    return sequence.isNull() | wrong
