"""Queries on methylation calls, consensus sites and splits."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from epispark.functions.coordinates import bin_start, natural_chrom_key
from epispark.operators import audit, calls as C, graph as H, nodes as N, splits as X
from epispark.params import RRBS_HG19
from epispark.sources import tables
from epispark.sources.staging import staging_folder
from epispark.workloads.bindings import PARAMS, Tables
from epispark.workloads.registry import Registry

_registry = Registry()
query = _registry.add
QUERIES, ORACLES = _registry.queries, _registry.oracles

_SITE_COLUMNS = """chrom, canonical_position, count_m, count_u, coverage,
       replicate_ratio_difference, label, consensus_methylation_ratio"""


@query("SELECT * FROM b_calls")
def scan_calls(t: Tables):
    return t.calls


@query("SELECT rep, chrom_start, strand, coverage FROM b_calls WHERE chrom = 'chr7'")
def scan_filtered(t: Tables):
    """From calls that are stored with their chromosome, in its order, so that the filter skips most of the file."""
    path = f"{staging_folder(t.spark)}/calls-{uuid.uuid4().hex}"
    t.calls.repartitionByRange("chrom", "chrom_start").sortWithinPartitions("chrom").write.parquet(path)
    return tables.read_chrom(t.spark, path, ["rep", "chrom_start", "strand", "coverage"], "chr7")


@query(f"""SELECT rep, chrom, chrom_start, strand FROM b_calls
           WHERE chrom IN ({', '.join(f"'{c}'" for c in PARAMS.chroms)})""")
def allowed_chroms(t: Tables):
    return C.keep_chroms(t.calls, PARAMS.chroms).select("rep", "chrom", "chrom_start", "strand")


@query("SELECT rep, chrom, chrom_start, coverage, count_m, count_u FROM b_counted_all")
def read_counts(t: Tables):
    counted = C.add_read_counts(t.calls)
    return counted.select("rep", "chrom", "chrom_start", "coverage", "count_m", "count_u")


@query("SELECT rep, chrom, chrom_start, strand, canonical_position FROM b_counted_all")
def canonical_position(t: Tables):
    placed = C.add_canonical_position(t.calls)
    return placed.select("rep", "chrom", "chrom_start", "strand", "canonical_position")


@query("""SELECT rep, chrom, canonical_position,
                 CAST(floor((canonical_position - 1) / 100.0) * 100 AS BIGINT) AS bin_start
          FROM b_counted_all""")
def bin_assign(t: Tables):
    placed = C.add_canonical_position(t.calls)
    return placed.select(
        "rep",
        "chrom",
        "canonical_position",
        bin_start(F.col("canonical_position"), PARAMS.bin_width).alias("bin_start"),
    )


@query("""SELECT rep, chrom, canonical_position, strand_row_count, count_m, count_u, coverage,
                 methylation_ratio FROM b_merged""")
def strand_merge(t: Tables):
    return t.merged


@query("SELECT rep, strand_row_count, count(*) AS site_count FROM b_merged GROUP BY ALL")
def strand_support(t: Tables):
    return C.strand_support(t.merged)


@query("""SELECT rep, count(*) AS site_count, count(*) FILTER (strand_row_count = 2) AS two_strand_count,
                 avg(CASE WHEN strand_row_count = 2 THEN 1 ELSE 0 END) AS two_strand_fraction
          FROM b_merged GROUP BY rep""")
def two_strand_fraction(t: Tables):
    return C.two_strand_fraction(t.merged)


@query("SELECT rep, chrom, canonical_position, coverage FROM b_merged WHERE coverage >= 10")
def min_coverage(t: Tables):
    kept = C.min_coverage(t.merged, PARAMS.min_replicate_coverage)
    return kept.select("rep", "chrom", "canonical_position", "coverage")


@query("""SELECT chrom, canonical_position, replicate_ratio_difference FROM b_both
          WHERE coverage >= 20 AND replicate_ratio_difference <= 0.2::DOUBLE""")
def replicate_concordance(t: Tables):
    both = C.in_both(C.pair_replicates(t.counted), PARAMS)
    kept = C.concordant(both, PARAMS)
    return kept.select("chrom", "canonical_position", "replicate_ratio_difference")


@query("SELECT chrom, canonical_position, count_m, count_u, label FROM b_consensus")
def site_label(t: Tables):
    return t.consensus.select("chrom", "canonical_position", "count_m", "count_u", "label")


@query(f"SELECT {_SITE_COLUMNS} FROM b_consensus")
def replicate_consensus(t: Tables):
    return C.consensus_sites(t.calls, PARAMS, ordered=True)


@query("""SELECT a.chrom, a.canonical_position, a.count_m + b.count_m AS count_m,
                 a.count_u + b.count_u AS count_u, a.coverage + b.coverage AS coverage,
                 abs(a.methylation_ratio - b.methylation_ratio) AS replicate_ratio_difference,
                 CAST(CASE WHEN a.count_m + b.count_m > a.count_u + b.count_u THEN 1 ELSE 0 END AS TINYINT)
                   AS label,
                 CAST(a.count_m + b.count_m AS DOUBLE) / nullif(a.coverage + b.coverage, 0)
                   AS consensus_methylation_ratio
          FROM b_merged a JOIN b_merged b USING (chrom, canonical_position)
          WHERE a.rep = 1 AND b.rep = 2 AND a.coverage >= 5 AND b.coverage >= 5
            AND abs(a.methylation_ratio - b.methylation_ratio) <= 0.2::DOUBLE""")
def replicate_consensus_low_floor(t: Tables):
    return C.consensus_sites(t.calls, replace(RRBS_HG19, chroms=PARAMS.chroms))


@query("""
    WITH s AS (
      SELECT rep, count(*) AS sites, count(*) FILTER (coverage >= 10) AS covered,
             CAST(sum(strand_row_count) AS BIGINT) AS n_rows FROM b_merged GROUP BY rep),
    a AS (SELECT rep, count(*) AS n FROM b_calls GROUP BY rep),
    b AS (SELECT count(*) AS both_n, count(*) FILTER (coverage >= 20) AS total_n,
                 count(*) FILTER (coverage >= 20 AND replicate_ratio_difference <= 0.2::DOUBLE) AS agree_n
          FROM b_both)
    SELECT CAST(3 * (s.rep - 1) AS INTEGER) AS stage_no, concat('rep', s.rep, ' rows on kept chromosomes') AS stage,
           n AS before, n_rows AS kept FROM s JOIN a USING (rep)
    UNION ALL SELECT 3 * (rep - 1) + 1, concat('rep', rep, ' sites after strand merge'), n_rows, sites FROM s
    UNION ALL SELECT 3 * (rep - 1) + 2, concat('rep', rep, ' sites with coverage'), sites, covered FROM s
    UNION ALL SELECT 6, 'sites in both replicates with total coverage', both_n, total_n FROM b
    UNION ALL SELECT 7, 'sites with concordant replicates', total_n, agree_n FROM b""")
def qc_funnel(t: Tables):
    return C.consensus_funnel(t.calls, PARAMS)


@query("SELECT name AS chrom, n AS site_count FROM b_call_counts")
def chrom_counts(t: Tables):
    return X.chrom_counts(t.consensus)


@query("SELECT chrom, split FROM b_call_split")
def greedy_split(t: Tables):
    return X.greedy_split(X.chrom_counts(t.consensus))


@query("SELECT chrom, canonical_position, label, split FROM b_split_sites")
def assign_splits(t: Tables):
    placed = X.split_sites(t.consensus)
    return placed.select("chrom", "canonical_position", "label", "split")


@query("""
    WITH s AS (
      SELECT split, count(*) AS n, count(DISTINCT chrom) AS chroms, sum(label::BIGINT) AS m,
             avg(label::BIGINT) AS mf, avg(coverage) AS c FROM b_split_sites GROUP BY split)
    SELECT d.split, coalesce(n, 0) AS row_count, coalesce(chroms, 0) AS chromosome_count,
           CAST(coalesce(n - m, 0) AS BIGINT) AS unmethylated_count,
           CAST(coalesce(m, 0) AS BIGINT) AS methylated_count,
           mf AS methylated_fraction, c AS mean_total_coverage,
           CAST(coalesce(n, 0) AS DOUBLE) / (SELECT count(*) FROM b_split_sites) AS fraction_of_consensus
    FROM (VALUES ('train'), ('validation'), ('test')) d(split) LEFT JOIN s ON d.split = s.split""")
def split_summary(t: Tables):
    return X.split_summary(X.split_sites(t.consensus))


@query("""SELECT count(*) FILTER (label = 1) AS methylated_count,
                 count(*) FILTER (label = 0) AS unmethylated_count,
                 avg(label::INTEGER) AS methylated_fraction FROM b_consensus""")
def label_balance(t: Tables):
    return C.label_balance(t.consensus)


@query("""SELECT chrom, canonical_position, split FROM b_split_sites WHERE split = 'train'
          UNION ALL SELECT chrom, canonical_position, split FROM b_split_sites WHERE split = 'validation'
          UNION ALL SELECT chrom, canonical_position, split FROM b_split_sites WHERE split = 'test'""")
def union_splits(t: Tables):
    placed = X.split_sites(t.consensus)
    parts = [
        placed.filter(F.col("split") == name).select("chrom", "canonical_position", "split")
        for name in ("train", "validation", "test")
    ]
    return X.union_splits(*parts)


@query("""SELECT chrom, count(DISTINCT split) AS split_count FROM b_split_sites GROUP BY chrom""")
def split_disjointness(t: Tables):
    placed = X.split_sites(t.consensus)
    shared = X.shared_groups(placed).select("chrom", F.lit(2).cast("bigint").alias("n"))
    chroms = placed.select("chrom").distinct()
    return chroms.join(shared, "chrom", "left").select(
        "chrom", F.coalesce("n", F.lit(1).cast("bigint")).alias("split_count")
    )


@query("SELECT DISTINCT chrom FROM b_split_sites")
def distinct_chroms(t: Tables):
    return X.distinct_chroms(X.split_sites(t.consensus))


@query("""SELECT chrom, coalesce(TRY_CAST(replace(chrom, 'chr', '') AS BIGINT), 10000) AS chrom_number,
                 CASE WHEN TRY_CAST(replace(chrom, 'chr', '') AS BIGINT) IS NULL
                      THEN replace(chrom, 'chr', '') ELSE '' END AS chrom_suffix
          FROM (SELECT DISTINCT chrom FROM b_calls) c""")
def natural_chrom_order(t: Tables):
    number, suffix = natural_chrom_key(F.col("chrom"))
    keyed = X.distinct_chroms(t.calls).select(
        "chrom", number.alias("chrom_number"), suffix.alias("chrom_suffix")
    )
    return keyed.orderBy("chrom_number", "chrom_suffix")


@query("""SELECT rep, chrom, chrom_start, strand, count(*) AS row_count FROM b_calls
          GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(t: Tables):
    return audit.duplicate_keys(t.calls, ["rep", "chrom", "chrom_start", "strand"])


@query("""SELECT count(*) FILTER (label = 0) AS negative_count, count(*) FILTER (label = 1) AS positive_count,
                 CAST(count(*) FILTER (label = 0) AS DOUBLE) / count(*) FILTER (label = 1) AS pos_weight
          FROM b_split_sites WHERE split = 'train'""")
def pos_weight(t: Tables):
    from epispark.operators.metrics import pos_weight as weight

    placed = X.split_sites(t.consensus)
    return weight(placed.filter(F.col("split") == "train"))


@query("""SELECT c.chrom, c.canonical_position, n.node_index
          FROM b_consensus c LEFT JOIN b_nodes n
            ON c.chrom = n.chrom AND n.bin_start = (c.canonical_position - 1) // 100 * 100""")
def site_to_node(t: Tables):
    linked = N.site_to_node(t.consensus, H.chrom_offsets(t.nodes), PARAMS.bin_width)
    return linked.select("chrom", "canonical_position", "node_index")


@query("""SELECT c.chrom, c.canonical_position FROM b_consensus c
          WHERE NOT EXISTS (SELECT 1 FROM b_nodes n JOIN b_sample_counts s USING (chrom, bin_start)
                            WHERE c.chrom = n.chrom AND n.bin_start = (c.canonical_position - 1) // 100 * 100)""")
def unmapped_sites(t: Tables):
    """Sites outside the nodes that have an embedding."""
    embedded = t.nodes.join(t.pooled.select("chrom", "bin_start"), ["chrom", "bin_start"], "left_semi")
    linked = N.join_nodes(t.consensus, embedded, PARAMS.bin_width)
    return N.unmapped_sites(linked).select("chrom", "canonical_position")


@query("""SELECT n.chrom, n.bin_start FROM b_nodes n
          WHERE NOT EXISTS (SELECT 1 FROM b_consensus c WHERE c.chrom = n.chrom
                            AND CAST(floor((c.canonical_position - 1) / 100.0) * 100 AS BIGINT) = n.bin_start)""")
def missing_keys_anti(t: Tables):
    from epispark.operators.genome import with_bin

    binned = with_bin(t.consensus, PARAMS.bin_width)
    return audit.missing_keys(t.nodes.select("chrom", "bin_start"), binned, ["chrom", "bin_start"])
