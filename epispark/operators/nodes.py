"""Vectors per graph node, and the node of every site."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions.vectors import mean_vector, zeros
from epispark.operators.genome import with_bin

BIN_KEY = ("chrom", "bin_start")

# Width of one step of the exponent when exponentials of any size are summed.
EXPONENT_STEP = 32

# Width of a block of nodes whose neighbours' vectors are mixed in one task, in longest edges.
BLOCK_REACHES = 8


def pool_embeddings(windows: DataFrame) -> DataFrame:
    """Mean embedding and number of windows of every bin."""
    return windows.groupBy(*BIN_KEY).agg(
        F.count("*").alias("sample_count"), mean_vector(F.col("embedding")).alias("embedding")
    )


def masked_mean(tokens: DataFrame, key: str = "seq_id") -> DataFrame:
    """Mean over the tokens whose mask is set; zeros where no token is.

    Masked tokens are zeroed and stay in the mean, which is then scaled by
    ``tokens / sum(mask)`` with the sum kept above 1e-9.
    """
    masked = F.transform("embedding", lambda x: x.cast("double") * F.col("mask"))
    means = tokens.groupBy(key).agg(
        F.count("*").alias("_tokens"),
        F.sum(F.col("mask").cast("double")).alias("_mask"),
        mean_vector(masked).alias("_mean"),
    )
    scale = F.col("_tokens") / F.greatest(F.col("_mask"), F.lit(1e-9))
    return means.select(key, F.transform("_mean", lambda x: x * scale).alias("embedding"))


def softmax_mean(rows: DataFrame, key: str, score: Column, vector: Column) -> DataFrame:
    """Mean vector of every key, weighted by the softmax of the score inside the key.

    The usual way subtracts each group's maximum first, which needs the whole group
    in one place or a second pass joined back. Instead every score is split into a
    multiple of a fixed step and a rest: the exponentials of the rests cannot
    overflow and are summed per (key, multiple) with partial aggregation, and only
    those few sums are brought to the key's largest multiple. A key may hold any
    share of the rows. A NULL or -inf score is a masked row of weight 0; a key with no
    other rows has a NULL vector.
    """
    step = float(EXPONENT_STEP)
    level = F.floor(score / F.lit(step))
    weighs = F.coalesce(score > float("-inf"), F.lit(False))
    parts = (
        rows.filter(weighs).withColumn("_level", level)
        .withColumn("_weight", F.exp(score - level * F.lit(step)))
        .groupBy(key, "_level")
        .agg(F.sum("_weight").alias("_weight"), mean_vector(vector, F.col("_weight")).alias("_mean"))
    )
    # exp underflows to zero 24 steps below the top, so few sums of a key are left to combine.
    top = F.max("_level").over(Window.partitionBy(key))
    scaled = parts.withColumn("_weight", F.col("_weight") * F.exp((F.col("_level") - top) * F.lit(step)))
    few = scaled.filter(F.col("_weight") > 0).groupBy(key).agg(
        F.sum("_weight").alias("_total"),
        F.collect_list(F.struct("_weight", "_mean")).alias("_parts"),
    )
    first = F.get("_parts", F.lit(0))["_mean"]

    def add(acc: Column, part: Column) -> Column:
        share = part["_weight"] / F.col("_total")
        return F.zip_with(acc, part["_mean"], lambda a, m: a + m * share)

    summed = F.aggregate("_parts", F.array_repeat(F.lit(0.0), F.size(first)), add)
    pooled = few.select(key, F.when(F.size("_parts") == 1, first).otherwise(summed).alias("embedding"))
    bare = rows.groupBy(key).agg(F.max(weighs).alias("_any")).filter("not _any")
    return pooled.unionByName(bare.select(key, F.lit(None).cast("array<double>").alias("embedding")))


def softmax_pool(tokens: DataFrame, key: str = "seq_id", score: str = "score") -> DataFrame:
    """Attention pooling of a sequence of vectors, with the scores given as a column."""
    return softmax_mean(tokens, key, F.col(score), F.col("embedding"))


def edge_softmax(edges: DataFrame, score: str) -> DataFrame:
    """Add ``attention``: the softmax of the score over the edges into one target.

    A target has at most one edge per bin inside the distance cap and its self-loop, so
    the window is bounded by the cap; it runs on the bare edges, before any vector is
    attached to them.
    """
    target = Window.partitionBy("dst")
    value = F.col(score).cast("double")
    weight = F.exp(value - F.max(value).over(target))
    weighted = edges.withColumn("_weight", weight)
    return weighted.withColumn(
        "attention", F.col("_weight") / F.sum("_weight").over(target)
    ).drop("_weight")


def neighbour_aggregate(edges: DataFrame, features: DataFrame, score: str, max_bins: int) -> DataFrame:
    """Mean of the neighbours' vectors at every target, weighted by the edges' softmax.

    No edge is longer than ``max_bins`` (one that is fails the query). So the nodes are cut
    into blocks several times wider than that, a vector goes to its own block and, from
    within ``max_bins`` of an end, to the block beside it, and the edges to the block of their
    target: one copy of most vectors instead of one per edge. A block holds a bounded number
    of vectors and edges and is summed in one task.
    """
    width = BLOCK_REACHES * (max_bins + 1)
    span = F.abs(F.col("src") - F.col("dst"))
    too_long = F.raise_error(F.lit(f"an edge is longer than {max_bins} bins")).cast("bigint")
    home = F.floor(F.col("dst") / F.lit(width))
    # A weight that underflows to zero adds nothing.
    messages = (
        edge_softmax(edges, score)
        .filter(F.col("attention") > 0)
        .select("src", "dst", "attention", F.when(span <= max_bins, home).otherwise(too_long).alias("block"))
    )
    own = F.floor(F.col("node_index") / F.lit(width))
    place = F.pmod("node_index", F.lit(width))
    before, after = F.when(place < max_bins, own - 1), F.when(place >= width - max_bins, own + 1)
    vectors = features.filter(F.col("features").isNotNull()).select(
        "node_index",
        F.col("features").cast("array<double>").alias("vector"),
        F.explode(F.array_compact(F.array(before, own, after))).alias("block"),
    )

    def mix(edges: pa.Table, nodes: pa.Table) -> pa.Table:
        order = np.argsort(nodes.column("node_index").to_numpy())
        known = nodes.column("node_index").to_numpy()[order]
        dst, src, share = (edges.column(c).to_numpy() for c in ("dst", "src", "attention"))
        place = np.minimum(np.searchsorted(known, src), max(len(known) - 1, 0))
        here = known[place] == src if len(known) else np.zeros(len(src), dtype=bool)
        by_target = np.argsort(dst[here], kind="stable")
        dst, place, share = dst[here][by_target], order[place[here][by_target]], share[here][by_target]
        targets, starts = np.unique(dst, return_index=True)
        means, length = np.empty(0), 0
        if len(targets):
            table = nodes.column("vector").combine_chunks().flatten().to_numpy().reshape(len(known), -1)
            total, length = np.add.reduceat(share, starts), table.shape[1]
            means = np.empty((len(targets), length))
            for lo in range(0, len(targets), 64):
                a = starts[lo]
                b = starts[lo + 64] if lo + 64 < len(targets) else len(dst)
                sums = np.add.reduceat(share[a:b, None] * table[place[a:b]], starts[lo : lo + 64] - a, axis=0)
                np.divide(sums, total[lo : lo + 64, None], out=means[lo : lo + 64])
        bounds = pa.array(np.arange(len(targets) + 1, dtype=np.int32) * np.int32(length))
        return pa.table({
            "dst": pa.array(targets, pa.int64()), "embedding": pa.ListArray.from_arrays(bounds, pa.array(means.ravel())),
        })

    return messages.groupBy("block").cogroup(vectors.groupBy("block")).applyInArrow(
        mix, "dst bigint, embedding array<double>"
    )


def node_features(nodes: DataFrame, pooled: DataFrame, width: int) -> DataFrame:
    """Embedding of every node; a node without one gets zeros and ``covered = false``."""
    found = pooled.select(*BIN_KEY, "sample_count", "embedding")
    return (
        nodes.join(found, list(BIN_KEY), "left")
        .withColumn("covered", F.col("embedding").isNotNull())
        .withColumn("embedding", F.coalesce("embedding", zeros(width)))
        .withColumn("sample_count", F.coalesce("sample_count", F.lit(0).cast("bigint")))
    )


def node_coverage(features: DataFrame) -> DataFrame:
    """Nodes with and without an embedding, per chromosome and overall (``all``)."""
    counted = features.rollup("chrom").agg(
        F.count("*").alias("node_count"),
        F.count_if("covered").alias("covered_count"),
        F.count_if(~F.col("covered")).alias("uncovered_count"),
    )
    return counted.withColumn("chrom", F.coalesce("chrom", F.lit("all")))


def extra_features(features: DataFrame, chroms: Sequence[str]) -> DataFrame:
    """Add ``extra``: one-hot chromosome, relative position, relative sample count.

    The chromosome ends and the largest sample count are two tiny aggregates joined
    back (one row per chromosome); a window over a chromosome would put all of its
    nodes into one task.
    """
    ends = features.groupBy("chrom").agg(
        F.max("bin_end").alias("_end"), F.max("sample_count").alias("_most")
    )
    ends = ends.withColumn("_most", F.max("_most").over(Window.partitionBy(F.lit(1))))
    one_hot = [(F.col("chrom") == c).cast("double") for c in chroms]
    position = F.col("bin_start") / F.col("_end")
    count = F.col("sample_count").cast("double")
    sampled = F.when(F.col("_most") > 0, count / F.col("_most")).otherwise(count)
    return (
        features.join(F.broadcast(ends), "chrom")
        .withColumn("extra", F.array(*one_hot, position, sampled))
        .drop("_end", "_most")
    )


def full_features(with_extra: DataFrame) -> DataFrame:
    """Embedding and extra features as one vector."""
    return with_extra.withColumn("features", F.concat("embedding", "extra"))


def join_nodes(sites: DataFrame, nodes: DataFrame, bin_width: int) -> DataFrame:
    """Add the node of every site by its bin, for any numbering; NULL outside all bins."""
    lookup = nodes.select(*BIN_KEY, "node_index")
    return with_bin(sites, bin_width).join(lookup, list(BIN_KEY), "left")


def site_to_node(sites: DataFrame, offsets: DataFrame, bin_width: int) -> DataFrame:
    """Add the node of every site, for nodes numbered bin by bin; NULL outside all bins.

    The number of a bin is then its chromosome's first node plus its place, so the
    lookup needs one row per chromosome (broadcast) and the sites stay where they are.
    """
    first = offsets.select("chrom", "node_offset", "chrom_length")
    start = F.col("bin_start")
    inside = (start >= 0) & (start < F.col("chrom_length"))
    node = F.col("node_offset") + F.floor(start / F.lit(bin_width))
    return (
        with_bin(sites, bin_width)
        .join(F.broadcast(first), "chrom", "left")
        .withColumn("node_index", F.when(inside, node))
        .drop("node_offset", "chrom_length")
    )


def unmapped_sites(linked: DataFrame) -> DataFrame:
    return linked.filter(F.col("node_index").isNull())


def sample_summary(sampled_flags: DataFrame) -> DataFrame:
    """Source sites, selected sites and nodes, per chromosome and overall (``all``).

    ``sampled_flags`` has ``chrom, bin_start, selected``. Counted per bin first, so
    the number of nodes is a count of rows.
    """
    per_bin = sampled_flags.groupBy(*BIN_KEY).agg(
        F.count("*").alias("source"), F.count_if("selected").alias("selected")
    )
    counted = per_bin.rollup("chrom").agg(
        F.sum("source").alias("source_count"),
        F.sum("selected").alias("selected_count"),
        F.count("*").alias("node_count"),
    )
    return counted.withColumn("chrom", F.coalesce("chrom", F.lit("all")))


def pending_keys(expected: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose output does not exist yet."""
    return expected.select(*key).distinct().join(done.select(*key), list(key), "left_anti")
