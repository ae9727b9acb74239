"""Queries on vectors per node."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.operators import audit, nodes as N, splits as X
from epispark.sources.staging import staged
from epispark.workloads.bindings import PARAMS, Tables, digest, long_form
from epispark.workloads.registry import Registry

_registry = Registry()
query = _registry.add
QUERIES, ORACLES = _registry.queries, _registry.oracles


@query("""SELECT chrom, bin_start, count(*) AS sample_count FROM b_wemb GROUP BY ALL""")
def node_embeddings_scan(t: Tables):
    """A table of one chromosome and one of all others in one, after checking that no bin is in two of them."""
    parts = [t.pooled.filter(F.col("chrom") == "chr1"), t.pooled.filter(F.col("chrom") != "chr1")]
    whole = X.union_splits(*parts)
    again = audit.duplicate_keys(whole, ["chrom", "bin_start"])
    return audit.missing_keys(whole, again, ["chrom", "bin_start"]).select(
        "chrom", "bin_start", "sample_count"
    )


@query("SELECT chrom, bin_start, sample_count, dim, round(v, 6) AS value FROM b_pooled")
def pool_embeddings(t: Tables):
    return long_form(t.pooled, ["chrom", "bin_start", "sample_count"], "embedding")


@query("""SELECT seq_id, dim, round(sum(v * mask) / greatest(sum(mask), 1e-9::DOUBLE), 6) AS value
          FROM b_token_values GROUP BY seq_id, dim""")
def masked_mean_pool(t: Tables):
    return long_form(N.masked_mean(t.tokens), ["seq_id"], "embedding")


@query("""
    WITH m AS (SELECT seq_id, max(score) AS top FROM b_tokens GROUP BY seq_id)
    SELECT seq_id, dim, round(sum(v * exp(score - top)) / sum(exp(score - top)), 6) AS value
    FROM b_token_values JOIN m USING (seq_id) GROUP BY seq_id, dim""")
def softmax_pool(t: Tables):
    return long_form(N.softmax_pool(t.tokens), ["seq_id"], "embedding")


@query("""
    SELECT n.node_index, n.chrom, n.bin_start, n.covered, n.sample_count, CAST(64 AS INTEGER) AS width,
           round(coalesce(ws, 0), 6) AS weighted_sum, round(coalesce(qs, 0), 6) AS square_sum
    FROM b_node_counts n LEFT JOIN (
      SELECT node_index, sum(v * (dim + 1)) AS ws, sum(v * v) AS qs FROM b_node_vectors GROUP BY 1) d
    USING (node_index)""")
def node_features(t: Tables):
    return t.node_features.select(
        "node_index", "chrom", "bin_start", "covered", "sample_count", *digest("embedding")
    )


@query("""
    WITH c AS (SELECT chrom, count(*) AS node_count, count(*) FILTER (covered) AS covered_count,
                      count(*) FILTER (NOT covered) AS uncovered_count FROM b_node_counts GROUP BY chrom)
    SELECT * FROM c UNION ALL
    SELECT 'all', CAST(sum(node_count) AS BIGINT), CAST(sum(covered_count) AS BIGINT),
           CAST(sum(uncovered_count) AS BIGINT) FROM c""")
def node_coverage(t: Tables):
    return N.node_coverage(t.node_features)


@query("""SELECT node_index, dim, round(v, 6) AS value FROM b_extra""")
def node_extra_features(t: Tables):
    extra = N.extra_features(t.node_features, PARAMS.chroms)
    return long_form(extra, ["node_index"], "extra")


@query("""SELECT node_index, dim, round(v, 6) AS value FROM b_full""")
def node_full_features(t: Tables):
    return long_form(t.full_features, ["node_index"], "features")


@query("""
    WITH e AS (SELECT src, dst, observed_expected::DOUBLE AS s FROM b_edge_features),
    m AS (SELECT dst, max(s) AS top FROM e GROUP BY dst),
    w AS (SELECT src, e.dst, exp(s - top) AS w FROM e JOIN m USING (dst)),
    z AS (SELECT dst, sum(w) AS total FROM w GROUP BY dst),
    v AS (SELECT w.dst, f.dim, sum(w.w * f.v) / any_value(z.total) AS v
          FROM w JOIN b_full f ON w.src = f.node_index JOIN z ON w.dst = z.dst GROUP BY w.dst, f.dim)
    SELECT dst, dim, round(v, 6) AS value FROM v""")
def neighbour_aggregate(t: Tables):
    edges = staged(t.edge_features.select("src", "dst", "observed_expected"), "edges")
    features = staged(t.full_features.select("node_index", "features"), "features")
    mixed = N.neighbour_aggregate(edges, features, "observed_expected", PARAMS.max_contact_bins)
    return long_form(mixed, ["dst"], "embedding")


@query("""SELECT vec_id, false AS finite FROM embeddings
          WHERE len(list_filter(embedding, lambda x: NOT isfinite(1.0 / round(x, 2)))) > 0""")
def finite_check(t: Tables):
    """Vectors of reciprocals of rounded values: a zero gives an infinity."""
    inverse = F.transform(
        "embedding",
        lambda x: F.coalesce(
            F.try_divide(F.lit(1.0), F.round(x.cast("double"), 2)), F.lit(float("inf"))
        ),
    )
    rows = t.table("embeddings").select("vec_id", inverse.alias("inverse"))
    found = audit.nonfinite_vectors(rows, "inverse")
    return found.select("vec_id", F.lit(False).alias("finite"))


@query("""SELECT vec_id, CAST(64 - vec_id % 3 AS INTEGER) AS width FROM embeddings WHERE vec_id % 3 <> 0""")
def vector_width(t: Tables):
    """Vectors cut short by the remainder of their id."""
    cut = F.slice("embedding", F.lit(1), (64 - F.col("vec_id") % 3).cast("int"))
    rows = t.table("embeddings").select("vec_id", cut.alias("embedding"))
    found = audit.wrong_width(rows, "embedding", PARAMS.embedding_width)
    return found.select("vec_id", F.size("embedding").alias("width"))
