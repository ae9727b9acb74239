"""Genome tiles from an indexed FASTA file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.schemas import FASTA_INDEX, TILES


def read_fasta_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FASTA_INDEX).option("sep", "\t").csv(path)


#: Most bytes of neighbouring tiles that one request reads.
RUN_BYTES = 8 << 20


def tile_ranges(index: DataFrame, tile_width: int, flank: int) -> DataFrame:
    """Byte range in the FASTA file of every tile with its flanks."""
    width = F.lit(tile_width).cast("bigint")
    starts = index.filter(F.col("length") > 0).withColumn(
        "tile_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, width))
    )
    first = F.greatest(F.col("tile_start") - flank, F.lit(0).cast("bigint"))
    last = F.least(F.col("tile_start") + width + flank, F.col("length")) - 1

    def byte_of(base):
        line = F.floor(base / F.col("line_bases"))
        return F.col("offset") + line * F.col("line_width") + base % F.col("line_bases")

    return starts.select(
        "chrom",
        F.col("length").alias("chrom_length"),
        F.floor(F.col("tile_start") / width).alias("tile_no"),
        "tile_start",
        first.alias("seq_start"),
        byte_of(first).alias("first_byte"),
        byte_of(last).alias("last_byte"),
    )


def read_fasta_tiles(
    spark: SparkSession, path: str, index: DataFrame, tile_width: int, flank: int, partitions: int
) -> DataFrame:
    """Tiles of a fixed-width FASTA file on a shared filesystem.

    Every task opens the file once and reads only the bytes of its own tiles, neighbouring
    ones in one request of at most ``RUN_BYTES``, so the longest chromosome is spread over
    the cluster like any other.
    """
    ranges = tile_ranges(index, tile_width, flank).repartitionByRange(partitions, "first_byte")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(inner) as handle:
            for batch in batches:
                batch = batch.sort_values("first_byte", ignore_index=True)
                spans, text = list(zip(batch["first_byte"].tolist(), batch["last_byte"].tolist())), []
                at = 0
                while at < len(spans):
                    begin, end = spans[at]
                    stop = at + 1
                    while stop < len(spans) and spans[stop][0] <= end + 1 and spans[stop][1] - begin < RUN_BYTES:
                        end = max(end, spans[stop][1])
                        stop += 1
                    run = handle.read_at(end - begin + 1, begin)
                    text += [run[a - begin : b - begin + 1].decode("ascii") for a, b in spans[at:stop]]
                    at = stop
                batch["seq"] = [t.replace("\n", "").replace("\r", "").upper() for t in text]
                yield batch[TILES.fieldNames()]

    return ranges.mapInPandas(read, TILES)
