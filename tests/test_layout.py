"""Layouts that plans rely on: pushed filters, and stored tables that joins leave where they are."""

import re

import numpy as np
import pytest

from epispark import workloads
from epispark.operators import genome as G
from epispark.operators import nodes as N
from epispark.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(df):
    """The file scans below an exchange of the plan."""
    lines, found = plan(df).splitlines(), []
    for k, line in enumerate(lines):
        if "FileScan" in line:
            depth, above = len(re.match(r"[ :|+\-*()\d]*", line)[0]), []
            for other in reversed(lines[:k]):
                there = len(re.match(r"[ :|+\-*()\d]*", other)[0])
                if there < depth:
                    above.append(other)
                    depth = there
            found.append((line, any("Exchange" in x for x in above)))
    return found


def test_the_filter_reaches_the_scan(spark):
    text = plan(workloads.queries()["scan_filtered"](spark, "/root/testdata/sf0.001"))
    assert "EqualTo(chrom,chr7)" in re.search(r"PushedFilters: \[(.*?)\]", text)[1]


def test_stored_tiles_are_not_moved(spark, tmp_path, no_broadcast):
    rng = np.random.default_rng(1)
    contigs = spark.createDataFrame([(f"chr{k}", "".join(rng.choice(list("ACGT"), 900))) for k in range(6)], "chrom string, seq string")
    tiles = G.tile_contigs(contigs, 50, 10)
    stored = tables.write_tiles(tiles, "tiles_of_test", f"{tmp_path}/tiles", 16)
    sites = G.cg_sites(tiles, 50).select("chrom", "canonical_position")
    sites.write.parquet(f"{tmp_path}/sites")
    sites = spark.read.parquet(f"{tmp_path}/sites")
    found = G.site_windows(sites, stored, 50, 21)
    scans = moved(found)
    assert [far for line, far in scans if "Bucketed: true" in line] == [False]
    assert [far for line, far in scans if "Bucketed: true" not in line] == [True]
    want = G.site_windows(sites, tiles, 50, 21)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    spark.sql("DROP TABLE tiles_of_test")


def test_stored_embeddings_are_not_moved(spark, tmp_path, no_broadcast):
    rows = [(f"chr{k % 3}", 100 * (k // 3), k, [float(k), 1.0]) for k in range(60)]
    pooled = spark.createDataFrame(rows, "chrom string, bin_start bigint, sample_count bigint, embedding array<double>")
    stored = tables.write_node_embeddings(pooled, "embeddings_of_test", f"{tmp_path}/embeddings", 16)
    nodes = spark.createDataFrame([(c, 100 * b, 100 * b + 100, 30 * n + b) for n, c in enumerate(("chr0", "chr1")) for b in range(30)],
                                  "chrom string, bin_start bigint, bin_end bigint, node_index bigint")
    nodes.write.parquet(f"{tmp_path}/nodes")
    found = N.node_features(spark.read.parquet(f"{tmp_path}/nodes"), stored, 2)
    assert [far for line, far in moved(found) if "Bucketed: true" in line] == [False]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(found) == key(N.node_features(nodes, pooled, 2))
    spark.sql("DROP TABLE embeddings_of_test")
