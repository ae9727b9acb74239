"""Checks that return the offending rows, and the guards built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.vectors import all_finite


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)


def nonfinite_vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(~all_finite(F.col(vector)))


def wrong_width(df: DataFrame, vector: str, width: int) -> DataFrame:
    return df.filter(F.col(vector).isNull() | (F.size(vector) != width))


def missing_keys(expected: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*key), list(key), "left_anti")


def require_empty(offenders: DataFrame, message: str) -> None:
    """Raise if there is any offending row; stops at the first ones found."""
    found = offenders.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {[row.asDict() for row in found]}")


def require_at_least(df: DataFrame, column: str, floor: float, message: str) -> None:
    """Raise if the column is below the floor in any row."""
    require_empty(df.filter(F.col(column) < floor), message)


def require_share(part: int | None, whole: int | None, floor: float, message: str) -> None:
    """Raise if ``part`` is below the share ``floor`` of ``whole``; nothing of nothing passes."""
    if whole and (part or 0) / whole < floor:
        raise ValueError(f"{message}: {part} of {whole}")


def require_none(count: int | None, message: str) -> None:
    """Raise if offending rows were counted."""
    if count:
        raise ValueError(f"{message}: {count} rows")


def require_same_count(left: DataFrame, right: DataFrame, message: str) -> None:
    require_equal(left.count(), right.count(), message)


def require_equal(left: int, right: int, message: str) -> None:
    if left != right:
        raise ValueError(f"{message}: {left} and {right} rows")


def alignment(left: DataFrame, right: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sites of two feature sets compared, one row per site.

    Both have ``chrom, canonical_position, label``; ``left`` also has the stored
    ``node_index``. ``nodes`` maps a site to the node computed anew. Each site gets the
    first reason that applies, or ``aligned``. Rows are counted per site before the sets
    meet, so a repeated site fans out nowhere; a NULL label equals only a NULL label.
    """
    key = ["chrom", "canonical_position"]

    def per_site(rows: DataFrame, name: str, *more: str) -> DataFrame:
        label = F.coalesce(F.col("label").cast("int"), F.lit(-1))
        return rows.groupBy(*key).agg(
            F.count("*").alias(f"_{name}_rows"), F.min(label).alias(f"_{name}_low"), F.max(label).alias(f"_{name}_high"),
            F.sum(label).alias(f"_{name}_sum"), *[F.min(c).alias(f"_{c}_low") for c in more],
            *[F.max(c).alias(f"_{c}_high") for c in more],
        )

    a, b = per_site(left, "left", "node_index"), per_site(right, "right")
    c = nodes.groupBy(*key).agg(F.min("node_index").alias("_computed"), F.max("node_index").alias("_computed_high"))
    labels = [F.col(f"_left_{c}") == F.col(f"_right_{c}") for c in ("low", "high", "sum")]
    stored = [F.col(x).eqNullSafe(F.col("_computed")) for x in ("_node_index_low", "_node_index_high", "_computed_high")]
    reason = (
        F.when(F.col("_left_rows").isNull(), "only in the second set")
        .when(F.col("_right_rows").isNull(), "only in the first set")
        .when(F.col("_left_rows") != F.col("_right_rows"), "row counts differ")
        .when(~(labels[0] & labels[1] & labels[2]), "labels differ")
        .when(F.col("_computed").isNull(), "no node")
        .when(~(stored[0] & stored[1] & stored[2]), "nodes differ")
        .otherwise("aligned")
    )
    joined = a.join(b, key, "full").join(c, key, "left")
    return joined.select(*key, reason.alias("outcome"))


def alignment_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("outcome").agg(F.count("*").alias("site_count"))


def audit_manifest(
    files: DataFrame, assembly: str, output_type: str, status: str = "released"
) -> DataFrame:
    """Add the first reason a listed file must not be used, or NULL."""

    def differs(column: str, expected: str) -> Column:
        return ~F.col(column).eqNullSafe(F.lit(expected))

    return files.withColumn(
        "failure",
        F.when(differs("assembly", assembly), "wrong assembly")
        .when(differs("output_type", output_type), "wrong output type")
        .when(differs("status", status), "not released"),
    )


def integrity(files: DataFrame) -> DataFrame:
    """Compare measured size and MD5 with the expected ones; NULL means not checked.

    A file of the right size that is already there is not fetched again.
    """
    size_ok = F.col("expected_size").isNull() | (F.col("size") == F.col("expected_size"))
    md5_ok = F.col("expected_md5").isNull() | (F.col("md5") == F.col("expected_md5"))
    return files.withColumn(
        "outcome",
        F.when(~size_ok, "size mismatch").when(~md5_ok, "md5 mismatch").otherwise("ok"),
    ).withColumn("can_skip_fetch", (F.col("size") > 0) & size_ok)
