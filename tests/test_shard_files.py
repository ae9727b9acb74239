"""The sink of shard files: what the manifest says is there, and nothing else."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from epispark.operators.shards import explode_manifest
from epispark.sources import files, shard_files


def rows(spark, n, size=10):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), F.floor(F.col("id") / size).alias("shard_index"),
        "id", F.array_repeat(F.col("id").cast("smallint"), 4).alias("codes"),
    ).repartition(5)


def listed(spark, path):
    return {(r.split, r.shard_index): r for r in explode_manifest(files.read_manifests(spark, f"{path}/manifest")).collect()}


def on_disk(path):
    return {os.path.relpath(f, f"{path}/shards") for f in glob.glob(f"{path}/shards/**/*.parquet", recursive=True)}


def test_files_and_manifest_agree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shard_files, "LISTED", 7)
    path = str(tmp_path)
    for n in (235, 120):  # the second job replaces the first
        shard_files.write_shard_files(rows(spark, n), f"{path}/shards", f"{path}/manifest", "codes", 10)
        found = listed(spark, path)
        assert {r.file for r in found.values()} == on_disk(path)
        want = {(r.split, r.shard_index): r["count"] for r in rows(spark, n).groupBy("split", "shard_index").count().collect()}
        assert {k: r.row_count for k, r in found.items()} == want
        assert all(r.codes_width == 4 and r.shard_size == 10 for r in found.values())
        assert {r.split: (r.total_rows, r.shard_count) for r in found.values()} == {
            s: (sum(v for k, v in want.items() if k[0] == s), sum(k[0] == s for k in want)) for s in ("test", "train")
        }
        for key, r in found.items():
            part = spark.read.parquet(f"{path}/shards/{r.file}")
            assert part.count() == r.row_count and part.select("shard_index").distinct().first()[0] == key[1]
        back = spark.read.parquet(f"{path}/shards")
        assert sorted(r.id for r in back.collect()) == list(range(n))


def test_lost_attempts_leave_nothing(spark, tmp_path):
    """A failing task: its files go, and the job before stays readable by its manifest."""
    path = str(tmp_path)
    shard_files.write_shard_files(rows(spark, 50), f"{path}/shards", f"{path}/manifest", "codes", 10)
    before = on_disk(path)
    broken = rows(spark, 100).withColumn(
        "id", F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("bigint"))
    )
    with pytest.raises(Exception, match="lost"):
        shard_files.write_shard_files(broken, f"{path}/shards", f"{path}/manifest", "codes", 10)
    assert on_disk(path) == before == {r.file for r in listed(spark, path).values()}
    stray = f"{path}/shards/split=test/shard-00000000-feedfeedfeed-7.parquet"
    with open(f"{path}/shards/{next(iter(before))}", "rb") as source, open(stray, "wb") as copy:
        copy.write(source.read())
    shard_files.write_shard_files(rows(spark, 50), f"{path}/shards", f"{path}/manifest", "codes", 10)
    assert not os.path.exists(stray) and on_disk(path) == {r.file for r in listed(spark, path).values()}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path)
    shard_files.write_shard_files(rows(spark, 10).limit(0), f"{path}/shards", f"{path}/manifest", "codes", 10)
    assert on_disk(path) == set()
