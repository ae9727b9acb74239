"""The genome as a table of tiles, and lookups in it.

A chromosome is never one row. A tile owns ``tile_width`` bases and carries a flank
on both sides, so the window around any owned base, and any CG that starts in it,
lies inside that one row: an interval lookup becomes an equi-join on
``(chrom, tile_no)``, and a scan for CGs together with their windows needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.coordinates import bin_start
from epispark.operators.indexing import even_sample_in_row

# Bins of one row that is dealt out when bins are cut.
STRETCH = 256


def tile_contigs(contigs: DataFrame, tile_width: int, flank: int) -> DataFrame:
    """Tiles of contigs that are small enough to arrive as one string each.

    The string is cut in one linear pass; cutting with a substring per tile would
    walk it from the start every time.
    """
    if not 1 <= flank <= tile_width:
        raise ValueError("the flank must be between 1 and the tile width")
    pieces = contigs.select(
        "chrom",
        F.length("seq").cast("bigint").alias("chrom_length"),
        F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s).{{1,{tile_width}}}"), F.lit(0)).alias("pieces"),
    )

    def tile(piece: Column, i: Column) -> Column:
        before = F.coalesce(F.substring(F.get("pieces", i - 1), -flank, flank), F.lit(""))
        after = F.coalesce(F.substring(F.get("pieces", i + 1), 1, flank), F.lit(""))
        start = i.cast("bigint") * tile_width
        return F.struct(
            i.cast("bigint").alias("tile_no"),
            start.alias("tile_start"),
            F.greatest(start - flank, F.lit(0).cast("bigint")).alias("seq_start"),
            F.concat(before, piece, after).alias("seq"),
        )

    return pieces.select("chrom", "chrom_length", F.inline(F.transform("pieces", tile)))


def window_of(position: Column, window: int) -> Column:
    """The window centred on a 1-based position, cut from the tile of the same row."""
    start = position - 1 - window // 2
    inside = (start >= 0) & (start + window <= F.col("chrom_length"))
    text = F.substring(F.col("seq"), (start - F.col("seq_start") + 1).cast("int"), F.lit(window))
    return F.when(inside, F.upper(text))


def site_windows(sites: DataFrame, tiles: DataFrame, tile_width: int, window: int) -> DataFrame:
    """Add ``sequence``: NULL for an unknown chromosome or a window past either end."""
    position = F.col("canonical_position")
    keyed = sites.withColumn("tile_no", F.floor((position - 1) / F.lit(tile_width)).cast("bigint"))
    lookup = tiles.select("chrom", "tile_no", "chrom_length", "seq_start", "seq")
    return (
        keyed.join(lookup, ["chrom", "tile_no"], "left")
        .withColumn("sequence", window_of(position, window))
        .drop("tile_no", "chrom_length", "seq_start", "seq")
    )


def cg_hits(tile_width: int) -> Column:
    """1-based positions of every CG whose C the tile owns.

    The owned bases and one more are split at each CG; the running length of the
    pieces gives the hits. Work is linear in the tile, and only a hit costs a step.
    """
    owned = F.substring(
        F.col("seq"), (F.col("tile_start") - F.col("seq_start") + 1).cast("int"), F.lit(tile_width + 1)
    )
    pieces = F.split(owned, "CG")
    start = F.struct(
        F.col("tile_start").alias("at"), F.array().cast("array<bigint>").alias("hits")
    )
    return F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        start,
        lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece) + 2).alias("at"),
            F.array_append(acc["hits"], acc["at"] + F.length(piece) + 1).alias("hits"),
        ),
        lambda acc: acc["hits"],
    )


def cg_sites(tiles: DataFrame, tile_width: int, window: int | None = None) -> DataFrame:
    """Every CG of the genome; with ``window``, its sequence as well, without a join."""
    hits = tiles.withColumn("canonical_position", F.explode(cg_hits(tile_width)))
    if window is None:
        return hits.select("chrom", "canonical_position")
    return hits.select(
        "chrom",
        "canonical_position",
        window_of(F.col("canonical_position"), window).alias("sequence"),
    )


def sampled_cg_windows(tiles: DataFrame, bin_width: int, window: int, limit: int) -> DataFrame:
    """At most ``limit`` evenly spaced CGs of every bin, with their windows.

    For tiles as wide as the bins. A tile then is a bin: the scan, the sample and the
    windows all come from one row, and nothing is shuffled or joined.
    """
    hits = tiles.withColumn("_hits", cg_hits(bin_width)).filter(F.size("_hits") > 0)
    picked = hits.withColumn(
        "canonical_position", F.explode(even_sample_in_row(F.col("_hits"), limit))
    )
    return picked.select(
        "chrom",
        F.col("tile_start").alias("bin_start"),
        "canonical_position",
        window_of(F.col("canonical_position"), window).alias("sequence"),
    )


def genome_bins(chrom_lengths: DataFrame, bin_width: int) -> DataFrame:
    """Fixed-width bins of every chromosome; an empty chromosome has none.

    Chromosomes are few and may all come in one task, and the bins cut from one row are
    held in memory together with what is made of them. So stretches of ``STRETCH`` bins are
    cut first and dealt out to as many tasks as a shuffle has.
    """
    width, stretch = (F.lit(n).cast("bigint") for n in (bin_width, bin_width * STRETCH))
    tasks = int(chrom_lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, stretch)
    stretches = chrom_lengths.filter(F.col("length") > 0).select("chrom", "length", F.explode(first).alias("_first"))
    last = F.least(F.col("_first") + stretch, F.col("length")) - 1
    return (
        stretches.repartition(tasks)
        .withColumn("bin_start", F.explode(F.sequence(F.col("_first"), last, width)))
        .withColumn("bin_end", F.least(F.col("bin_start") + width, F.col("length")))
        .select("chrom", "bin_start", "bin_end")
    )


def with_bin(sites: DataFrame, bin_width: int) -> DataFrame:
    return sites.withColumn("bin_start", bin_start(F.col("canonical_position"), bin_width))


def keep_expected_bins(sites: DataFrame, expected: DataFrame) -> DataFrame:
    return sites.join(expected.select("chrom", "bin_start"), ["chrom", "bin_start"], "left_semi")
