"""Table reads with pushed filters, and the sinks of the flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.schemas import HISTORY


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_chrom(spark: SparkSession, path: str, columns: Sequence[str], chrom: str) -> DataFrame:
    """Columns of one chromosome; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).filter(F.col("chrom") == chrom).select(*columns)


def write_splits(sites: DataFrame, path: str) -> None:
    """One table with a folder per split and chromosome.

    Rows are spread by position inside a chromosome, so the largest one is written by
    many tasks.
    """
    block = F.floor(F.col("canonical_position") / F.lit(10_000_000))
    (
        sites.repartition("split", "chrom", block)
        .write.mode("overwrite")
        .partitionBy("split", "chrom")
        .parquet(path)
    )


def write_shards(rows: DataFrame, path: str) -> None:
    """A folder per split and shard."""
    (
        rows.repartition("split", "shard_index")
        .write.mode("overwrite")
        .partitionBy("split", "shard_index")
        .parquet(path)
    )


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of a few rows as headed CSV."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; ``append`` adds epochs to a training history."""
    rows.write.mode(mode).json(path)


def write_history(epochs: DataFrame, path: str) -> None:
    """Add epochs to a training history."""
    epochs.select(*HISTORY.fieldNames()).write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def history_values(history: DataFrame, figure: str, split: str = "validation") -> DataFrame:
    """``run_id, epoch, phase`` and one figure of a split under its own name."""
    return history.select("run_id", "epoch", "phase", F.col(f"{split}.{figure}").alias(figure))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table that may not have been written yet, or has no row so far."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_pending(rows: DataFrame, path: str, partition: str = "chrom") -> None:
    """Replace only the partitions that ``rows`` has."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def write_bucketed(rows: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table kept at ``path``, its rows dealt and sorted by ``keys`` once and for all.

    A join on exactly these keys leaves it where it is and deals out the other side only,
    as long as it has no fewer ``buckets`` than ``spark.sql.shuffle.partitions``. Returns the table.
    """
    (
        rows.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    )
    return rows.sparkSession.table(name)


def write_tiles(tiles: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Genome tiles for ``site_windows``: written once for an assembly, joined by many sets of sites."""
    return write_bucketed(tiles, name, path, ("chrom", "tile_no"), buckets)


def write_node_embeddings(pooled: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Pooled embeddings for ``node_features``: the vectors stay where they are, the bare nodes move."""
    return write_bucketed(pooled, name, path, ("chrom", "bin_start"), buckets)
