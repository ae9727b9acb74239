"""Row numbers over a whole sorted table, and samples inside a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_running_sum(df: DataFrame, value: str, order_by: list[str], name: str) -> DataFrame:
    """Sum of the rows before, for a table known to be small (one row per task, chromosome ...)."""
    before = Window.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint"))


def position_blocks(width: int = 100_000) -> list[Column]:
    """Chromosome and stretch of positions: blocks of rows in genome order."""
    return [F.col("chrom"), F.floor(F.col("canonical_position") / F.lit(width))]


def hash_blocks(key: str) -> list[Column]:
    """Beginnings of a hash in hexadecimal: blocks of rows in the order of the hash."""
    return [F.substring(key, 1, 2), F.substring(key, 1, 5)]


def with_row_index(
    df: DataFrame, order_by: list[str], blocks: list[Column], name: str = "row_index", group: str | None = None
) -> DataFrame:
    """0-based position of every row in the order ``order_by`` (which must be total).

    With ``group`` the positions start anew in each of a few large groups, such as the
    splits. ``blocks`` cut the order into stretches, the first coarser than the others: they
    rise with ``order_by`` and are never null. Rows are counted per block, the counts added up
    over the coarse blocks and inside each, and a row's place inside its own block comes on
    top. So a window holds one block, or one row per block, never a group; rows are moved
    once and nothing is stored.
    """
    keys = [group] if group else []
    names = [f"_block{i}" for i in range(len(blocks))]
    placed = df.withColumns(dict(zip(names, blocks)))
    counts = placed.groupBy(*keys, *names).agg(F.count("*").alias("_size"))
    coarse = counts.groupBy(*keys, names[0]).agg(F.sum("_size").alias("_size"))
    coarse = _running(coarse, keys, names[:1], "_coarse").drop("_size")
    fine = _running(counts, [*keys, names[0]], names[1:] or names[:1], "_fine").drop("_size")
    offsets = fine.join(coarse, [*keys, names[0]])
    place = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order_by))
    return (
        placed.withColumn("_place", place)
        .join(offsets, [*keys, *names])
        .select(*df.columns, (F.col("_coarse") + F.col("_fine") + F.col("_place") - 1).cast("bigint").alias(name))
    )


def _running(counts: DataFrame, keys: list[str], order_by: list[str], name: str) -> DataFrame:
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*order_by)
    total = F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn(name, F.coalesce(total, F.lit(0)))


def even_sample_flag(sites: DataFrame, limit: int) -> DataFrame:
    """Add ``selected``: at most ``limit`` evenly spaced sites per bin, first and last included.

    Positions inside a bin are distinct, so no bin holds more rows than its width.
    """
    by_bin = Window.partitionBy("chrom", "bin_start")
    ranked = sites.withColumn(
        "_rank", F.row_number().over(by_bin.orderBy("canonical_position")) - 1
    ).withColumn("_size", F.count("*").over(by_bin))
    rank, size = F.col("_rank"), F.col("_size")
    if limit == 1:
        kept = rank == 0
    else:
        step = (size - 1).cast("double") / F.lit(float(limit - 1))
        # The ranks wanted are floor(i * step); only the i next to rank / step can give this rank.
        near = F.floor(F.try_divide(rank.cast("double"), step))
        on_grid = F.lit(False)
        for shift in (-1, 0, 1):
            i = near + shift
            on_grid = on_grid | ((i >= 0) & (i <= limit - 2) & (F.floor(i * step) == rank))
        kept = (size <= limit) | (rank == size - 1) | on_grid
    return ranked.withColumn("selected", kept).drop("_rank", "_size")


def even_sample(sites: DataFrame, limit: int) -> DataFrame:
    return even_sample_flag(sites, limit).filter("selected").drop("selected")


def even_sample_in_row(ordered: Column, limit: int) -> Column:
    """The same sample from an ordered array that already is one bin: no shuffle."""
    size = F.size(ordered)
    if limit == 1:
        return F.slice(ordered, F.lit(1), F.lit(1))
    step = (size - 1).cast("double") / F.lit(float(limit - 1))
    ranks = F.transform(
        F.sequence(F.lit(0), F.lit(limit - 1)),
        lambda i: F.when(i == limit - 1, size - 1).otherwise(F.floor(i * step).cast("int")),
    )
    picked = F.transform(ranks, lambda rank: F.get(ordered, rank))
    return F.when(size <= limit, ordered).otherwise(picked)
