"""Contact records to a sparse weighted graph over genome bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions.coordinates import normalize_chrom
from epispark.functions.vectors import is_finite
from epispark.operators.genome import genome_bins
from epispark.operators.indexing import exclusive_running_sum

EDGE_FEATURES = ("log_count", "observed_expected", "log_distance", "is_self_loop")


def normalize_chrom_sizes(sizes: DataFrame, chroms: Sequence[str]) -> DataFrame:
    """``raw_name, length`` to ``chrom, raw_name, length`` for the kept chromosomes."""
    named = sizes.withColumn("chrom", normalize_chrom(F.col("raw_name")))
    return named.filter(F.col("chrom").isin(*chroms)).select("chrom", "raw_name", "length")


def missing_chroms(sizes: DataFrame, chroms: Sequence[str]) -> DataFrame:
    """Expected chromosomes the table lacks."""
    wanted = F.array(*[F.lit(c) for c in chroms])
    expected = sizes.sparkSession.range(1).select(F.explode(wanted).alias("chrom"))
    return expected.join(sizes.select("chrom"), "chrom", "left_anti")


def node_index(sizes: DataFrame, bin_width: int, chroms: Sequence[str]) -> DataFrame:
    """Number the bins of all chromosomes 0, 1, 2 ... in the given chromosome order.

    The number is the bin's ordinal plus the bins of the chromosomes before. The
    running sum is over the chromosome table (one row per listed name), never over bins.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in chroms]), F.col("chrom"))
    counted = (
        sizes.filter(F.col("chrom").isin(*chroms))
        .withColumn("_order", order)
        .withColumn("_bins", F.ceil(F.col("length") / F.lit(bin_width)))
    )
    offsets = exclusive_running_sum(counted, "_bins", ["_order"], "_offset")
    bins = genome_bins(offsets.select("chrom", "length"), bin_width)
    return bins.join(F.broadcast(offsets.select("chrom", "_offset")), "chrom").select(
        "chrom",
        "bin_start",
        "bin_end",
        (F.col("_offset") + F.floor(F.col("bin_start") / F.lit(bin_width))).alias("node_index"),
    )


def chrom_offsets(nodes: DataFrame) -> DataFrame:
    """First node and length of every chromosome."""
    return nodes.groupBy("chrom").agg(
        F.min("node_index").alias("node_offset"), F.max("bin_end").alias("chrom_length")
    )


def bin_contacts(contacts: DataFrame, resolution: int) -> DataFrame:
    """Contacts in base coordinates to contacts between bins."""

    def to_bin(position: str) -> Column:
        return F.floor(F.col(position) / F.lit(resolution))

    return contacts.select(
        "chrom", to_bin("pos_x").alias("bin_x"), to_bin("pos_y").alias("bin_y"), "count"
    )


def finite_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.filter(is_finite(F.col("count")))


def near_contacts(contacts: DataFrame, max_bins: int) -> DataFrame:
    return contacts.filter(F.abs(F.col("bin_x") - F.col("bin_y")) <= max_bins)


def contacts_inside(contacts: DataFrame, offsets: DataFrame, bin_width: int) -> DataFrame:
    """``contacts`` on listed chromosomes; reading a bin outside its chromosome fails, since its
    number would be that of a node of another one."""
    lengths = F.broadcast(offsets.select("chrom", F.ceil(F.col("chrom_length") / bin_width).alias("_bins")))

    def checked(column: str) -> Column:
        value = F.col(column)
        outside = F.raise_error(F.concat(F.lit("a contact lies outside "), "chrom")).cast("bigint")
        return F.when((value >= 0) & (value < F.col("_bins")), value).otherwise(outside)

    return contacts.join(lengths, "chrom").withColumns(
        {c: checked(c) for c in ("bin_x", "bin_y")}
    ).drop("_bins")


def _mirror(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair ``lo <= hi``; a diagonal pair stays single."""
    there = F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    back = F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"))
    both = F.when(F.col("lo") == F.col("hi"), F.array(there)).otherwise(F.array(there, back))
    return pairs.select(F.explode(both).alias("edge"), "weight").select("edge.*", "weight")


def symmetric_edges(contacts: DataFrame, offsets: DataFrame, drop_diagonal: bool = False) -> DataFrame:
    """Directed edges ``src, dst, weight`` in both directions, duplicate records summed.

    Summed per unordered pair before mirroring, which shuffles half as many rows as
    summing the mirrored edges. A record on the diagonal counts once.
    """
    placed = contacts.join(F.broadcast(offsets.select("chrom", "node_offset")), "chrom")
    x = F.col("node_offset") + F.col("bin_x")
    y = F.col("node_offset") + F.col("bin_y")
    pairs = (
        placed.groupBy(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
        .agg(F.sum(F.col("count").cast("double")).alias("weight"))
    )
    if drop_diagonal:
        pairs = pairs.filter(F.col("lo") != F.col("hi"))
    return _mirror(pairs)


def topk_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest edges of every source; among equal weights the lower target first.

    A source has at most one edge per target inside the distance cap, so no group grows
    with the number of contact records.
    """
    by_weight = Window.partitionBy("src").orderBy(F.desc("weight"), F.asc("dst"))
    return (
        edges.withColumn("neighbour_rank", F.row_number().over(by_weight))
        .filter(F.col("neighbour_rank") <= k)
    )


def topk_union(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are among the top ``k`` of either end, in both directions.

    Grouping the kept edges per unordered pair takes the maximum of both directions
    at once; pairs without weight vanish.
    """
    kept = topk_neighbours(edges, k)
    pairs = (
        kept.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .agg(F.max("weight").alias("weight"))
        .filter(F.col("weight") > 0)
    )
    return _mirror(pairs)


def expected_by_distance(edges: DataFrame) -> DataFrame:
    """Mean weight of the edges at each distance in bins, pooled over all chromosomes."""
    return (
        edges.groupBy(F.abs(F.col("src") - F.col("dst")).alias("distance"))
        .agg(F.sum("weight").alias("weight_sum"), F.count("*").alias("edge_count"))
        .withColumn("expected", F.col("weight_sum") / F.col("edge_count"))
    )


def edge_features(
    edges: DataFrame, nodes: DataFrame, bin_width: int, max_bins: int
) -> DataFrame:
    """Four features per edge, plus one neutral self-loop per node.

    The expectation has one row per distance. No edge may be longer than ``max_bins``
    (one that is makes the query fail), so these are at most ``max_bins + 1`` rows, which
    are broadcast; joining by the distance itself would send all edges to a few hundred
    keys, the short distances the heaviest.
    """
    too_long = F.raise_error(F.lit(f"an edge is longer than {max_bins} bins")).cast("bigint")
    span = F.abs(F.col("src") - F.col("dst"))
    distance = F.when(span <= max_bins, span).otherwise(too_long)
    expected = F.broadcast(
        expected_by_distance(edges).select(
            F.when(F.col("distance") <= max_bins, F.col("distance")).otherwise(too_long).alias("distance"), "expected"
        )
    )
    observed = (
        edges.withColumn("distance", distance)
        .join(expected, "distance")
        .select(
            "src",
            "dst",
            F.log1p("weight").cast("float").alias("log_count"),
            (F.col("weight") / F.greatest(F.col("expected"), F.lit(1e-9)))
            .cast("float")
            .alias("observed_expected"),
            F.log1p(F.col("distance").cast("double") * bin_width).cast("float").alias("log_distance"),
            F.lit(0.0).cast("float").alias("is_self_loop"),
        )
    )
    values = (0.0, 1.0, 0.0, 1.0)
    loops = nodes.select(
        F.col("node_index").alias("src"),
        F.col("node_index").alias("dst"),
        *[F.lit(v).cast("float").alias(name) for name, v in zip(EDGE_FEATURES, values)],
    )
    return observed.unionByName(loops)


def chroms_without_contacts(nodes: DataFrame, contacts: DataFrame) -> DataFrame:
    chroms = nodes.select("chrom").distinct()
    return chroms.join(contacts.select("chrom"), "chrom", "left_anti")
