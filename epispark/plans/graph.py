"""Contacts to a graph, and sequence embeddings to its nodes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.functions.coordinates import normalize_chrom
from epispark.functions.vectors import all_finite
from epispark.operators import audit
from epispark.operators import balance as B
from epispark.operators import genome as G
from epispark.operators import graph as H
from epispark.operators import indexing as I
from epispark.operators import learn
from epispark.operators import nodes as N
from epispark.operators import quality as Q
from epispark.params import Params
from epispark.schemas import NODE_EMBEDDINGS
from epispark.sources import tables, versions
from epispark.sources.staging import written


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def build_graph(sizes: DataFrame, contacts: DataFrame, params: Params, path: str) -> Graph:
    """Write ``nodes``, ``edges`` and ``chroms_without_contacts``.

    ``sizes`` has ``raw_name, length``; ``contacts`` has ``chrom, bin_x, bin_y, count``,
    the chromosome in any of the usual spellings. Raw counts are balanced over whole
    chromosomes, before the distance cap, if ``balance_steps`` asks for it.
    """
    spark = sizes.sparkSession
    named = H.normalize_chrom_sizes(sizes, params.chroms)
    audit.require_empty(H.missing_chroms(named, params.chroms), "chromosomes are missing")
    numbered = H.node_index(named, params.bin_width, params.chroms)
    numbered.write.mode("overwrite").parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    audit.require_empty(audit.duplicate_keys(nodes, N.BIN_KEY), "bins are listed twice")

    named_contacts = contacts.withColumn("chrom", normalize_chrom(F.col("chrom")))
    if params.balance_steps:
        listed = named_contacts.filter(F.col("chrom").isin(*params.chroms))
        named_contacts = B.balance_contacts(
            listed, params.balance_steps, params.balance_tolerance, params.min_balance_partners
        )
    usable = H.near_contacts(H.finite_contacts(named_contacts), params.max_contact_bins)
    if usable.isEmpty():
        raise ValueError("no usable contact on any chromosome")
    tables.write_summary(H.chroms_without_contacts(nodes, usable), f"{path}/chroms_without_contacts")
    offsets = H.chrom_offsets(nodes)
    inside = H.contacts_inside(usable, offsets, params.bin_width)
    adjacency = H.symmetric_edges(inside, offsets, params.drop_diagonal)
    kept = H.topk_union(adjacency, params.top_k)
    featured = H.edge_features(kept, nodes, params.bin_width, params.max_contact_bins)
    finite = all_finite(F.array(*H.EDGE_FEATURES))
    edges, seen = written(featured, f"{path}/edges", wrong=F.count_if(~finite))
    audit.require_none(seen["wrong"], "edge features are not finite")
    return Graph(nodes, edges)


def sample_windows(source: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """Windows to embed: ``chrom, bin_start, canonical_position, sequence``.

    With ``sample_whole_genome`` the source is the tiles and every CG counts; otherwise
    it is the windowed sites of all splits.
    """
    if not params.sample_whole_genome:
        binned = G.with_bin(source, params.bin_width)
        return I.even_sample(binned, params.max_sampled_sites).select(
            *N.BIN_KEY, "canonical_position", "sequence"
        )
    if params.tile_width == params.bin_width:
        sampled = G.sampled_cg_windows(source, params.bin_width, params.window, params.max_sampled_sites)
        expected = G.keep_expected_bins(sampled, nodes)
    else:
        found = G.with_bin(G.cg_sites(source, params.tile_width, params.window), params.bin_width)
        expected = I.even_sample(G.keep_expected_bins(found, nodes), params.max_sampled_sites)
    return Q.candidate_windows(expected, params.window, params.max_unknown_fraction)


def embed_nodes(
    source: DataFrame,
    nodes: DataFrame,
    params: Params,
    path: str,
    name: str,
    load: Callable[[], learn.Model],
) -> DataFrame:
    """Pool the embeddings of the sampled windows per node.

    Chromosomes are recorded as finished once written, also one without any window, and
    skipped from then on.
    """
    spark = nodes.sparkSession
    out = f"{path}/node_embeddings"
    chroms = nodes.select("chrom").distinct()
    finished = f"{path}/node_embeddings_finished"
    done = tables.read_or_empty(spark, finished, chroms.schema)
    chroms = N.pending_keys(chroms, done, ["chrom"])
    pending = source.join(F.broadcast(chroms), "chrom", "left_semi")
    windows = sample_windows(pending, nodes, params)
    embedded = learn.embed_windows(windows, name, load, params.embedding_width)
    tables.write_pending(N.pool_embeddings(embedded), out)
    chroms.write.mode("append").parquet(finished)
    return tables.read_or_empty(spark, out, NODE_EMBEDDINGS)


def build_node_features(nodes: DataFrame, pooled: DataFrame, params: Params, path: str) -> DataFrame:
    """Write ``node_coverage``; write and return ``node_features``: one full vector per node."""
    audit.require_empty(audit.duplicate_keys(pooled, N.BIN_KEY), "bins are embedded twice")
    covered = N.node_features(nodes, pooled, params.embedding_width)
    tables.write_summary(N.node_coverage(covered), f"{path}/node_coverage")
    if params.extra_node_features:
        full = N.full_features(N.extra_features(covered, params.chroms))
    else:
        full = covered.withColumnRenamed("embedding", "features")
    kept = full.select("node_index", *N.BIN_KEY, "covered", "sample_count", "features")
    features, seen = written(
        kept, f"{path}/node_features", rows=F.count("*"), wrong=F.count_if(~all_finite(F.col("features")))
    )
    audit.require_equal(nodes.count(), seen["rows"] or 0, "nodes were lost or doubled")
    audit.require_none(seen["wrong"], "node features are not finite")
    return features


def link_sites(sites: DataFrame, nodes: DataFrame, params: Params, path: str) -> DataFrame:
    """Write and return the node of every site; a site without one is an error."""
    linked = N.site_to_node(sites, H.chrom_offsets(nodes), params.bin_width).select(
        "split", "chrom", "canonical_position", "node_index"
    )
    found, seen = written(
        linked, f"{path}/site_nodes", ("split",), unmapped=F.count_if(F.col("node_index").isNull())
    )
    audit.require_none(seen["unmapped"], "sites lie outside all bins")
    return found


def publish_graph(sizes: DataFrame, contacts: DataFrame, params: Params, path: str) -> Graph:
    """``build_graph`` as a new version of ``path``, current once its guards have passed."""
    return versions.publish(sizes.sparkSession, path, lambda folder: build_graph(sizes, contacts, params, folder))
