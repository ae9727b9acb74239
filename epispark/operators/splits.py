"""Whole chromosomes to train, validation and test."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epispark.params import SPLIT_FRACTIONS


def chrom_counts(sites: DataFrame, group: str = "chrom") -> DataFrame:
    return sites.groupBy(group).agg(F.count("*").alias("site_count"))


def greedy_split(
    counts: DataFrame,
    group: str = "chrom",
    fractions: tuple[tuple[str, float], ...] = SPLIT_FRACTIONS,
) -> DataFrame:
    """Give each chromosome, largest first, to the split that lacks most rows.

    Each choice depends on all before it, so the groups (not their rows) pass through one
    task, sorted and one Arrow batch at a time; any number of them takes linear time.
    """
    whole = Window.partitionBy(F.lit(1))
    ordered = (
        counts.select(group, "site_count", F.sum("site_count").over(whole).alias("_total"))
        .repartition(1)
        .sortWithinPartitions(F.desc("site_count"), group)
    )

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {name: 0 for name, _ in fractions}
        for batch in batches:
            chosen = []
            totals = batch.column("_total").to_pylist()
            for rows, total in zip(batch.column("site_count").to_pylist(), totals):
                split = max(fractions, key=lambda part: total * part[1] - held[part[0]])[0]
                held[split] += rows
                chosen.append(split)
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(chosen, pa.string())], [group, "split"])

    return ordered.mapInArrow(give, f"{group} {dict(counts.dtypes)[group]}, split string")


def assign_splits(sites: DataFrame, split_map: DataFrame, group: str = "chrom") -> DataFrame:
    """Add ``split``; whether the map is small enough to broadcast is left to Spark."""
    return sites.join(split_map, group)


def split_sites(sites: DataFrame, group: str = "chrom") -> DataFrame:
    return assign_splits(sites, greedy_split(chrom_counts(sites, group), group), group)


def split_names(sites: DataFrame) -> DataFrame:
    """The splits as a three-row table."""
    names = F.array(*[F.lit(name) for name, _ in SPLIT_FRACTIONS])
    return sites.sparkSession.range(1).select(F.explode(names).alias("split"))


def split_summary(sites: DataFrame) -> DataFrame:
    """One row per split, also for a split without rows.

    Aggregated per chromosome first: the distinct count of chromosomes then runs over
    a handful of rows instead of expanding every site.
    """
    label = F.col("label").cast("bigint")
    per_chrom = sites.groupBy("split", "chrom").agg(
        F.count("*").alias("n"), F.sum(label).alias("m"), F.sum("coverage").alias("c")
    )
    per_split = per_chrom.groupBy("split").agg(
        F.count("*").alias("chromosome_count"),
        F.sum("n").alias("n"),
        F.sum("m").alias("m"),
        F.sum("c").alias("c"),
    )
    total = F.sum("row_count").over(Window.partitionBy(F.lit(1)))
    return (
        split_names(sites)
        .join(per_split, "split", "left")
        .select(
            "split",
            F.coalesce("n", F.lit(0)).alias("row_count"),
            F.coalesce("chromosome_count", F.lit(0)).alias("chromosome_count"),
            F.coalesce(F.col("n") - F.col("m"), F.lit(0)).alias("unmethylated_count"),
            F.coalesce("m", F.lit(0)).alias("methylated_count"),
            (F.col("m") / F.col("n")).alias("methylated_fraction"),
            (F.col("c") / F.col("n")).alias("mean_total_coverage"),
        )
        .withColumn("fraction_of_consensus", F.try_divide(F.col("row_count"), total))
    )


def union_splits(*splits: DataFrame) -> DataFrame:
    """Rows of all splits in one table, columns matched by name."""
    whole = splits[0]
    for other in splits[1:]:
        whole = whole.unionByName(other)
    return whole


def shared_groups(sites: DataFrame, group: str = "chrom") -> DataFrame:
    """Chromosomes found in more than one split; empty when the splits are disjoint."""
    return (
        sites.groupBy(group)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def distinct_chroms(sites: DataFrame) -> DataFrame:
    return sites.select("chrom").distinct()
