"""Queries on the contact graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions.coordinates import normalize_chrom as normalized
from epispark.operators import graph as H
from epispark.operators.balance import balance_contacts
from epispark.workloads.bindings import PARAMS, Tables
from epispark.workloads.registry import Registry

_registry = Registry()
query = _registry.add
QUERIES, ORACLES = _registry.queries, _registry.oracles


@query("SELECT chrom, bin_x, bin_y, count FROM b_contacts")
def scan_contacts(t: Tables):
    width = PARAMS.bin_width
    in_bases = t.contacts.select(
        "chrom",
        (F.col("bin_x") * width + F.col("bin_y") % width).alias("pos_x"),
        (F.col("bin_y") * width + F.col("bin_x") % width).alias("pos_y"),
        "count",
    )
    return H.bin_contacts(in_bases, width)


@query("""SELECT l_orderkey, l_linenumber, raw_name,
                 CASE WHEN k < 22 THEN concat('chr', 1 + k) WHEN k = 22 THEN 'chrX'
                      WHEN k = 23 THEN 'chrY' ELSE 'chrM' END AS chrom
          FROM lineitem l JOIN b_chrom_sizes s ON l.l_suppkey % 25 = s.k""")
def normalize_chrom(t: Tables):
    from epispark.workloads.bindings import RAW_NAME

    named = t.table("lineitem").withColumn("k", F.col("l_suppkey") % 25)
    rows = named.selectExpr("l_orderkey", "l_linenumber", f"{RAW_NAME} AS raw_name")
    return rows.withColumn("chrom", normalized(F.col("raw_name")))


@query("SELECT chrom, bin_x, bin_y, count FROM b_contacts WHERE isfinite(count)")
def finite_contacts(t: Tables):
    return H.finite_contacts(t.contacts)


@query("""SELECT chrom, bin_x, bin_y, count FROM b_contacts
          WHERE isfinite(count) AND abs(bin_x - bin_y) <= 40""")
def distance_filter(t: Tables):
    return H.near_contacts(H.finite_contacts(t.contacts), PARAMS.max_contact_bins)


@query("SELECT chrom, bin_start, bin_end, node_index FROM b_nodes")
def node_index(t: Tables):
    return t.nodes


@query("SELECT chrom, node_offset, chrom_length FROM b_offsets")
def chrom_offsets(t: Tables):
    return H.chrom_offsets(t.nodes)


@query("SELECT src, dst, weight FROM b_edges")
def symmetric_contacts(t: Tables):
    return t.edges


@query("SELECT src, dst, weight, neighbour_rank FROM b_topk")
def topk_neighbours(t: Tables):
    return H.topk_neighbours(t.edges, PARAMS.top_k)


@query("SELECT src, dst, weight FROM b_kept")
def topk_union(t: Tables):
    return t.kept_edges


@query("SELECT distance, weight_sum, edge_count, round(expected, 6) AS expected FROM b_expected")
def expected_by_distance(t: Tables):
    found = H.expected_by_distance(t.kept_edges)
    return found.withColumn("expected", F.round("expected", 6))


@query("""SELECT src, dst, round(log_count::DOUBLE, 5) AS log_count,
                 round(observed_expected::DOUBLE, 5) AS observed_expected,
                 round(log_distance::DOUBLE, 5) AS log_distance, is_self_loop
          FROM b_edge_features""")
def oe_edges(t: Tables):
    rounded = [
        F.round(F.col(c).cast("double"), 5).alias(c)
        for c in ("log_count", "observed_expected", "log_distance")
    ]
    return t.edge_features.select("src", "dst", *rounded, "is_self_loop")


@query("""SELECT DISTINCT chrom FROM b_nodes WHERE chrom NOT IN
          (SELECT chrom FROM b_contacts WHERE isfinite(count))""")
def empty_contact_chroms(t: Tables):
    return H.chroms_without_contacts(t.nodes, H.finite_contacts(t.contacts))


BALANCE_STEPS, BALANCE_TOLERANCE = 10, 0.02


def _balanced(steps: int, tolerance: float) -> str:
    """The rounds of the balancing, one after the other; a settled chromosome stays as it is."""
    parts = ["""
    WITH m AS (SELECT chrom, a AS bin, b AS other, sum(count) AS w FROM (
                 SELECT chrom, bin_x AS a, bin_y AS b, count FROM b_contacts WHERE isfinite(count) AND count > 0
                 UNION ALL SELECT chrom, bin_y, bin_x, count FROM b_contacts
                 WHERE isfinite(count) AND count > 0 AND bin_x <> bin_y) u GROUP BY ALL),
    x0 AS (SELECT DISTINCT chrom, bin, 1.0::DOUBLE AS bias FROM m)"""]
    for k in range(steps + 1):
        parts.append(f"""
    r{k} AS MATERIALIZED (SELECT x.chrom, x.bin, any_value(x.bias) AS bias, any_value(x.bias) * sum(m.w * o.bias) AS r
             FROM x{k} x JOIN m ON m.chrom = x.chrom AND m.bin = x.bin JOIN x{k} o ON o.chrom = m.chrom AND o.bin = m.other
             GROUP BY x.chrom, x.bin)""")
        if k < steps:
            parts.append(f"""
    x{k + 1} AS MATERIALIZED (SELECT chrom, bin, CASE WHEN max(abs(r - 1)) OVER (PARTITION BY chrom) > {tolerance!r}::DOUBLE
                              THEN bias / sqrt(r) ELSE bias END AS bias FROM r{k})""")
    return ",".join(parts) + f""",
    f AS (SELECT chrom, bin, bias FROM r{steps} WHERE abs(r - 1) <= {tolerance!r}::DOUBLE),
    p AS (SELECT c.*, c.count * x.bias * y.bias AS v FROM b_contacts c
          LEFT JOIN f x ON x.chrom = c.chrom AND x.bin = c.bin_x LEFT JOIN f y ON y.chrom = c.chrom AND y.bin = c.bin_y),
    s AS (SELECT chrom, sum(count) / sum(v) AS scale FROM p WHERE isfinite(v) GROUP BY chrom)
    SELECT chrom, bin_x, bin_y, CASE WHEN v IS NULL OR isnan(v) THEN 'NaN'::DOUBLE ELSE round(v * scale, 5) END AS count
    FROM p LEFT JOIN s USING (chrom)"""


@query(_balanced(BALANCE_STEPS, BALANCE_TOLERANCE))
def balanced_contacts(t: Tables):
    made = balance_contacts(t.contacts, BALANCE_STEPS, BALANCE_TOLERANCE)
    return made.select("chrom", "bin_x", "bin_y", F.round("count", 5).alias("count"))
