"""From stranded calls of two replicates to labelled consensus sites."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.coordinates import canonical_position, methylated_count, safe_ratio
from epispark.params import Params

SITE_KEY = ("chrom", "canonical_position")


def keep_chroms(df: DataFrame, chroms: Iterable[str]) -> DataFrame:
    """Rows on the listed chromosomes.

    The null test is implied, but a later join on ``chrom`` would add it on its side only;
    with it here, both uses of the sites keep the same plan and share one shuffle.
    """
    chrom = F.col("chrom")
    return df.filter(chrom.isNotNull() & chrom.isin(*chroms))


def add_read_counts(calls: DataFrame) -> DataFrame:
    counted = calls.withColumn(
        "count_m", methylated_count(F.col("coverage"), F.col("percent_methylated"))
    )
    return counted.withColumn("count_u", F.col("coverage") - F.col("count_m"))


def add_canonical_position(calls: DataFrame) -> DataFrame:
    return calls.withColumn(
        "canonical_position", canonical_position(F.col("chrom_start"), F.col("strand"))
    )


def stranded_counts(calls: DataFrame, chroms: Iterable[str]) -> DataFrame:
    """Calls on the kept chromosomes with read counts and canonical positions."""
    return add_canonical_position(add_read_counts(keep_chroms(calls, chroms)))


def merge_strands(counted: DataFrame) -> DataFrame:
    """One row per replicate and site, with the read counts of both strands summed."""
    merged = counted.groupBy("rep", *SITE_KEY).agg(
        F.count("*").alias("strand_row_count"),
        F.sum("count_m").alias("count_m"),
        F.sum("count_u").alias("count_u"),
    )
    coverage = F.col("count_m") + F.col("count_u")
    return merged.withColumn("coverage", coverage).withColumn(
        "methylation_ratio", safe_ratio(F.col("count_m"), coverage)
    )


def strand_support(merged: DataFrame) -> DataFrame:
    return merged.groupBy("rep", "strand_row_count").agg(F.count("*").alias("site_count"))


def two_strand_fraction(merged: DataFrame) -> DataFrame:
    return merged.groupBy("rep").agg(
        F.count("*").alias("site_count"),
        F.count_if(F.col("strand_row_count") == 2).alias("two_strand_count"),
        F.avg((F.col("strand_row_count") == 2).cast("int")).alias("two_strand_fraction"),
    )


def min_coverage(merged: DataFrame, floor: int) -> DataFrame:
    return merged.filter(F.col("coverage") >= floor)


def _of_rep(rep: int, column: str) -> Column:
    return F.sum(F.when(F.col("rep") == rep, F.col(column)))


def pair_replicates(counted: DataFrame) -> DataFrame:
    """Strand merge and replicate join in one aggregation.

    Both steps share the key, so summing per replicate under that key replaces two
    aggregations and a join by a single shuffle of partial sums. Sites seen in only
    one replicate stay, with NULL in the other's columns.
    """
    sums = []
    for rep in (1, 2):
        sums.append(F.count_if(F.col("rep") == rep).alias(f"strand_row_count_rep{rep}"))
        for name in ("count_m", "count_u"):
            sums.append(_of_rep(rep, name).alias(f"{name}_rep{rep}"))
    paired = counted.groupBy(*SITE_KEY).agg(*sums)
    for rep in (1, 2):
        m, u = F.col(f"count_m_rep{rep}"), F.col(f"count_u_rep{rep}")
        paired = paired.withColumn(f"coverage_rep{rep}", m + u).withColumn(
            f"methylation_ratio_rep{rep}", safe_ratio(m, m + u)
        )
    return paired


def in_both(paired: DataFrame, params: Params) -> DataFrame:
    """Sites that reach the coverage floor in each replicate, with joint counts."""
    floor = params.min_replicate_coverage
    m = F.col("count_m_rep1") + F.col("count_m_rep2")
    u = F.col("count_u_rep1") + F.col("count_u_rep2")
    return (
        paired.filter((F.col("coverage_rep1") >= floor) & (F.col("coverage_rep2") >= floor))
        .withColumn("count_m", m)
        .withColumn("count_u", u)
        .withColumn("coverage", m + u)
        .withColumn(
            "replicate_ratio_difference",
            F.abs(F.col("methylation_ratio_rep1") - F.col("methylation_ratio_rep2")),
        )
    )


def concordant(both: DataFrame, params: Params) -> DataFrame:
    return both.filter(
        (F.col("coverage") >= params.min_total_coverage)
        & (F.col("replicate_ratio_difference") <= params.max_ratio_difference)
    )


def label_sites(sites: DataFrame) -> DataFrame:
    """A site is methylated when most of its reads are; a tie is not."""
    return sites.withColumn(
        "label", (F.col("count_m") > F.col("count_u")).cast("tinyint")
    ).withColumn("consensus_methylation_ratio", safe_ratio(F.col("count_m"), F.col("coverage")))


def consensus_sites(calls: DataFrame, params: Params, ordered: bool = False) -> DataFrame:
    """Labelled sites on which both replicates agree."""
    paired = pair_replicates(stranded_counts(calls, params.chroms))
    sites = label_sites(concordant(in_both(paired, params), params)).select(
        *SITE_KEY,
        "count_m",
        "count_u",
        "coverage",
        "replicate_ratio_difference",
        "label",
        "consensus_methylation_ratio",
    )
    return sites.orderBy(*SITE_KEY) if ordered else sites


def consensus_funnel(calls: DataFrame, params: Params) -> DataFrame:
    """How many rows or sites each stage keeps, from one pass over the calls.

    The allowed-chromosome test becomes a column instead of a filter so that a single
    aggregation sees the rows before and after every stage.
    """
    paired = pair_replicates(add_canonical_position(add_read_counts(calls)))
    allowed = F.col("chrom").isin(*params.chroms)
    floor = params.min_replicate_coverage
    m = F.col("count_m_rep1") + F.col("count_m_rep2")
    u = F.col("count_u_rep1") + F.col("count_u_rep2")
    agree = (
        F.abs(F.col("methylation_ratio_rep1") - F.col("methylation_ratio_rep2"))
        <= params.max_ratio_difference
    )
    covered = {
        rep: allowed & (F.coalesce(F.col(f"coverage_rep{rep}"), F.lit(-1)) >= floor)
        for rep in (1, 2)
    }
    both = covered[1] & covered[2]
    total = both & (F.coalesce(m + u, F.lit(-1)) >= params.min_total_coverage)
    rows = {rep: F.col(f"strand_row_count_rep{rep}") for rep in (1, 2)}

    def rows_where(rep: int, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows[rep])), F.lit(0))

    stages = []
    for rep in (1, 2):
        seen = allowed & (rows[rep] > 0)
        stages += [
            (f"rep{rep} rows on kept chromosomes", rows_where(rep, allowed), rows_where(rep, F.lit(True))),
            (f"rep{rep} sites after strand merge", F.count_if(seen), rows_where(rep, allowed)),
            (f"rep{rep} sites with coverage", F.count_if(covered[rep]), F.count_if(seen)),
        ]
    stages += [
        ("sites in both replicates with total coverage", F.count_if(total), F.count_if(both)),
        ("sites with concordant replicates", F.count_if(total & agree), F.count_if(total)),
    ]
    counts = [
        c.cast("bigint").alias(f"{kind}{i}")
        for i, (_, kept, before) in enumerate(stages)
        for kind, c in (("kept", kept), ("before", before))
    ]
    lines = F.array(*[
        F.struct(
            F.lit(i).alias("stage_no"),
            F.lit(name).alias("stage"),
            F.col(f"before{i}").alias("before"),
            F.col(f"kept{i}").alias("kept"),
        )
        for i, (name, _, _) in enumerate(stages)
    ])
    return paired.agg(*counts).select(F.inline(lines))


def label_balance(sites: DataFrame) -> DataFrame:
    return sites.agg(
        F.count_if(F.col("label") == 1).alias("methylated_count"),
        F.count_if(F.col("label") == 0).alias("unmethylated_count"),
        F.avg(F.col("label").cast("int")).alias("methylated_fraction"),
    )
