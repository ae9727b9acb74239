"""Fixed-size shards of coded windows, their manifests, and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions import sequence as S
from epispark.operators.calls import SITE_KEY
from epispark.operators.indexing import hash_blocks, position_blocks, with_row_index


MANIFEST_COLUMNS = (
    "split", "shard_index", "file", "row_count", "codes_width", "dtype", "shard_size", "total_rows", "shard_count"
)


def encode_windows(windows: DataFrame) -> DataFrame:
    """Both encodings of a window, stored as small integers and expanded on reading."""
    return windows.withColumn("base_codes", S.base_codes(F.col("sequence"))).withColumn(
        "pair_codes", S.pair_codes(F.col("base_codes"))
    )


def assign_shards(rows: DataFrame, shard_size: int) -> DataFrame:
    """Add ``shard_index``: rows of a split in genome order, ``shard_size`` to a shard."""
    indexed = with_row_index(rows, list(SITE_KEY), position_blocks(), group="split")
    return indexed.withColumn("shard_index", F.floor(F.col("row_index") / F.lit(shard_size)))


def shard_manifest(rows: DataFrame, codes: str, shard_size: int, name: str | None = None) -> DataFrame:
    """One row per shard, with the totals of its split. ``file`` is the folder of the shard, or
    the file ``name`` in it."""
    shards = rows.groupBy("split", "shard_index").agg(
        F.count("*").alias("row_count"), F.max(F.size(codes)).alias("codes_width")
    )
    totals = shards.groupBy("split").agg(
        F.sum("row_count").alias("total_rows"), F.count("*").alias("shard_count")
    )
    inside = f"/{name}" if name else ""
    file = F.format_string(f"split=%s/shard_index=%d{inside}", F.col("split"), F.col("shard_index"))
    return shards.join(totals, "split").select(
        "split",
        "shard_index",
        file.alias("file"),
        "row_count",
        "codes_width",
        F.lit("smallint").alias("dtype"),
        F.lit(shard_size).cast("bigint").alias("shard_size"),
        "total_rows",
        "shard_count",
    )


def expand_samples(
    rows: DataFrame, site_nodes: DataFrame, properties: Sequence[Sequence[float] | None]
) -> DataFrame:
    """Training samples from coded rows: both matrices, the node and the label of each site.

    Codes are an order of magnitude smaller than the matrices, so the node is joined
    first and the matrices are made last, where they are read.
    """
    linked = rows.join(site_nodes.select(*SITE_KEY, "node_index"), list(SITE_KEY))
    return linked.select(
        "split",
        "shard_index",
        *SITE_KEY,
        "node_index",
        "label",
        S.one_hot(F.col("base_codes")).alias("one_hot"),
        S.expand_codes(F.col("pair_codes"), properties).alias("properties"),
    )


def extraction_summary(manifest: DataFrame) -> DataFrame:
    """Rows and shards of every split."""
    return manifest.groupBy("split").agg(
        F.sum("row_count").alias("total_rows"), F.count("*").alias("shard_count")
    )


def shard_offsets(manifest: DataFrame) -> DataFrame:
    """Rows of the split before each shard, whatever the shards hold.

    Added up over blocks of a thousand shards and inside each, so that no window holds
    all shards of a split.
    """
    blocked = manifest.select("split", "shard_index", "row_count", F.floor(F.col("shard_index") / 1000).alias("_block"))
    before = Window.partitionBy("split").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("split", "_block").agg(F.sum("row_count").alias("_rows"))
    starts = totals.select("split", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("split", "_block").orderBy("shard_index").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("row_count").over(inside), F.lit(0))
    return (
        blocked.withColumn("_place", place)
        .join(starts, ["split", "_block"])
        .select("split", "shard_index", "row_count", (F.col("_start") + F.col("_place")).cast("bigint").alias("row_offset"))
    )


def compare_layouts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of every shard in two manifests, and whether they agree."""
    key = ["split", "shard_index"]
    a = left.select(*key, F.col("row_count").alias("left_rows"))
    b = right.select(*key, F.col("row_count").alias("right_rows"))
    agrees = F.col("left_rows").eqNullSafe(F.col("right_rows"))
    return a.join(b, key, "full").withColumn("agrees", agrees)


def nest_manifest(manifest: DataFrame) -> DataFrame:
    """One row per split, with its shards as a sorted list."""
    shard = F.struct("shard_index", "file", "row_count", "codes_width", "dtype")
    return manifest.groupBy("split", "shard_size", "total_rows", "shard_count").agg(
        F.array_sort(F.collect_list(shard)).alias("shards")
    )


def explode_manifest(manifests: DataFrame) -> DataFrame:
    """Nested manifests to one row per shard."""
    return manifests.select(
        "split", "shard_size", "total_rows", "shard_count", F.inline("shards")
    )


def epoch_key(key: list[Column | str], seed: int, epoch: int) -> Column:
    """Hash of the row key that differs from epoch to epoch and repeats with the seed."""
    return F.md5(F.concat_ws("|", *key, F.lit(str(seed + epoch))))


def epoch_shuffle(rows: DataFrame, key: list[str], seed: int, epoch: int) -> DataFrame:
    """Reorder the whole table at random, the same way on every run."""
    keyed = rows.withColumn("shuffle_key", epoch_key([F.col(k) for k in key], seed, epoch))
    return keyed.orderBy("shuffle_key", *key)


def shard_order(manifest: DataFrame, seed: int, epoch: int, workers: int = 1) -> DataFrame:
    """Order in which the shards of a split are read in an epoch, dealt out to workers."""
    key = epoch_key([F.col("split"), F.col("shard_index")], seed, epoch)
    placed = with_row_index(
        manifest.withColumn("_key", key), ["_key", "shard_index"], hash_blocks("_key"), name="place", group="split"
    )
    worker = F.pmod(F.col("place"), F.lit(workers).cast("bigint"))
    return placed.drop("_key").withColumn("worker", worker)


def pack_batches(
    rows: DataFrame, order_by: list[str], blocks: list[Column], fields: list[str], batch_size: int, workers: int = 1
) -> DataFrame:
    """Rows in order, ``batch_size`` to a batch, each batch with the worker it goes to."""
    indexed = with_row_index(rows, order_by, blocks)
    return (
        indexed.withColumn("batch_no", F.floor(F.col("row_index") / F.lit(batch_size)))
        .groupBy("batch_no")
        .agg(
            F.count("*").alias("row_count"),
            F.array_sort(F.collect_list(F.struct("row_index", *fields))).alias("samples"),
        )
        .withColumn("worker", F.pmod(F.col("batch_no"), F.lit(workers).cast("bigint")))
    )
