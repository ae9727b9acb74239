"""Guards in the pass that writes, and versions that are published only after them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from epispark.operators import genome as G
from epispark.params import WGBS_GRCH38
from epispark.plans import dataset
from epispark.sources import versions
from epispark.sources.staging import written

PARAMS = replace(WGBS_GRCH38, window=5, tile_width=50, bin_width=50, min_two_strand_fraction=0.5, chroms=("chr1", "chr2"))
SCHEMA = "rep int, chrom string, chrom_start bigint, strand string, coverage bigint, percent_methylated double"


def made(spark, strands):
    text = {"chr1": "ACGTA" * 30 + "NNCGT", "chr2": "TTCGA" * 20}
    tiles = G.tile_contigs(spark.createDataFrame(list(text.items()), "chrom string, seq string"), PARAMS.tile_width, PARAMS.center)
    rows = [
        (rep, chrom, p + (strand == "-"), strand, 20, 80.0)
        for chrom, seq in text.items() for p in range(len(seq) - 1) if seq[p:p + 2] == "CG"
        for rep in (1, 2) for strand in strands
    ]
    return spark.createDataFrame(rows, SCHEMA), tiles


def test_inputs_are_read_once(spark, tmp_path):
    calls, tiles = made(spark, "+-")
    counts = {}
    for name, df in (("calls", calls), ("tiles", tiles)):
        counts[name] = spark.sparkContext.accumulator(0)

    def counted(df, name):
        read = counts[name]

        def pass_on(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return df.mapInArrow(pass_on, df.schema)

    total = tiles.count()
    found = dataset.build_dataset(counted(calls, "calls"), counted(tiles, "tiles"), PARAMS, str(tmp_path))
    assert found.sites.count() > 40
    dropped = {r[0]: r[1] for r in found.dropped.collect()}
    assert counts["calls"].value == calls.count() and counts["tiles"].value == total
    assert sum(dropped.values()) + found.sites.count() == 51 and sum(dropped.values()) >= 1


def test_a_failed_guard_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    good, tiles = made(spark, "+-")
    dataset.publish_dataset(good, tiles, PARAMS, path)
    first = versions.current(spark, path)
    rows = spark.read.parquet(f"{first}/sites").count()
    bad, _ = made(spark, "+")
    with pytest.raises(ValueError, match="both strands"):
        dataset.publish_dataset(bad, tiles, PARAMS, path)
    assert versions.current(spark, path) == first and spark.read.parquet(f"{first}/sites").count() == rows
    dataset.publish_dataset(good.filter("chrom = 'chr1'"), tiles, PARAMS, path)
    second = versions.current(spark, path)
    assert second != first and spark.read.parquet(f"{second}/sites").count() < rows
    assert spark.read.parquet(f"{first}/sites").count() == rows


def test_figures_of_the_rows_written(spark, tmp_path):
    df = spark.range(1000).repartition(4)
    table, seen = written(df, f"{tmp_path}/a", n=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    assert (table.count(), seen) == (1000, {"n": 1000, "odd": 500})
    _, seen = written(df.filter("id < 0"), f"{tmp_path}/b", n=F.count("*"))
    assert not seen["n"]
    _, seen = written(spark.createDataFrame([], "id long"), f"{tmp_path}/c", n=F.count("*"))
    assert not seen["n"]
