"""The flows end to end on a made-up genome."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.operators import audit
from epispark.operators import genome as G
from epispark.operators import learn
from epispark.operators import shards as D
from epispark.params import RRBS_HG19, WGBS_GRCH38
from epispark.plans import dataset, features, graph
from epispark.sources import files

CHROMS = ("chr1", "chr2", "chrX")
SMALL = dict(window=21, tile_width=100, bin_width=100, max_contact_distance=1_000, top_k=3, shard_size=20,
             embedding_width=8, chroms=CHROMS, min_two_strand_fraction=0.0)
PRESETS = {
    "whole genome": replace(RRBS_HG19, max_sampled_sites=3, **SMALL),
    "observed sites": replace(WGBS_GRCH38, max_sampled_sites=3, **SMALL),
}


@pytest.fixture(scope="module")
def genome():
    rng = np.random.default_rng(7)
    texts = {c: "".join(rng.choice(list("ACGT"), n, p=[0.2, 0.3, 0.3, 0.2])) for c, n in zip(CHROMS, (4000, 1050, 700))}
    texts["chrX"] = texts["chrX"][:300] + "N" * 50 + texts["chrX"][350:]
    return texts


@pytest.fixture(scope="module")
def calls(spark, genome):
    rng = np.random.default_rng(8)
    rows = []
    for chrom, text in genome.items():
        for p in range(len(text) - 1):
            if text[p : p + 2] == "CG":
                level = int(rng.integers(0, 101))
                for rep in (1, 2):
                    for strand, start in (("+", p), ("-", p + 1)):
                        rows.append((rep, chrom, start, strand, int(rng.integers(4, 30)), float(level)))
    schema = "rep int, chrom string, chrom_start bigint, strand string, coverage bigint, percent_methylated double"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", PRESETS)
def test_flows(spark, tmp_path, genome, calls, name):
    params, path = PRESETS[name], str(tmp_path)
    contigs = spark.createDataFrame(list(genome.items()), "chrom string, seq string")
    tiles = G.tile_contigs(contigs, params.tile_width, params.center)

    made = dataset.build_dataset(calls, tiles, params, path)
    assert made.sites.count() > 50
    for row in made.sites.collect():
        p = row["canonical_position"]
        assert row["sequence"] == genome[row["chrom"]][p - 11 : p + 10]
    assert {r["split"] for r in made.summary.collect()} == {"train", "validation", "test"}
    assert sum(r["row_count"] for r in made.summary.collect()) == made.sites.count()
    assert made.dropped.count() >= 1

    sizes = spark.createDataFrame([("1", 4000), ("CHR2", 1050), (" x", 700), ("MT", 99)], "raw_name string, length bigint")
    rng = np.random.default_rng(9)
    pairs = [(c, int(a), int(min(a + d, n - 1)), float(w)) for c, n in zip(("1", "chr2", "x"), (40, 11, 7))
             for a, d, w in zip(rng.integers(0, n, 200), rng.integers(0, 15, 200), rng.integers(1, 50, 200))]
    contacts = spark.createDataFrame(pairs, "chrom string, bin_x bigint, bin_y bigint, count double")
    net = graph.build_graph(sizes, contacts, params, path)
    assert net.nodes.count() == 40 + 11 + 7
    edges = {(r["src"], r["dst"]) for r in net.edges.collect()}
    assert edges == {(b, a) for a, b in edges} and all((i, i) in edges for i in range(58))

    source = tiles if params.sample_whole_genome else made.sites
    load = learn.kmer_model(params.embedding_width)
    pooled = graph.embed_nodes(source, net.nodes, params, path, "small", load)
    before = pooled.count()
    assert before > 20 and pooled.agg(F.max("sample_count")).first()[0] <= 3
    again = graph.embed_nodes(source, net.nodes, params, path, "small", load)
    assert again.count() == before
    full = graph.build_node_features(net.nodes, pooled, params, path)
    assert audit.wrong_width(full, "features", 8 + len(CHROMS) + 2).count() == 0
    plain = graph.build_node_features(net.nodes, pooled, replace(params, extra_node_features=False), path + "/plain")
    assert audit.wrong_width(plain, "features", 8).count() == 0
    linked = graph.link_sites(made.sites, net.nodes, params, path)
    assert linked.count() == made.sites.count()

    shards = features.build_shards(made.sites, params, path)
    assert shards.rows.count() == made.sites.count()
    assert {r["split"]: r["total_rows"] for r in shards.summary.collect()} == {
        r["split"]: r["row_count"] for r in made.summary.collect() if r["row_count"]
    }
    features.check_alignment(shards.rows, shards.rows, linked, net.nodes, params)
    features.check_layout(shards.manifest, shards.manifest, params)
    back = D.explode_manifest(files.read_manifests(spark, f"{path}/manifest")).select(shards.manifest.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, shards.manifest.collect()))
    for r in back.collect():
        assert spark.read.parquet(f"{path}/shards/{r['file']}").count() == r["row_count"]
    assert spark.read.option("header", True).csv(f"{path}/node_coverage").filter("chrom = 'all'").count() == 1
    assert spark.read.option("header", True).csv(f"{path}/chroms_without_contacts").count() == 0
    table = [[float(code + j) for j in range(12)] for code in range(16)]
    sample = D.expand_samples(shards.rows, linked, table)
    assert sample.count() == made.sites.count()
    first = sample.first()
    text = genome[first["chrom"]][first["canonical_position"] - 11 : first["canonical_position"] + 10]
    assert first["node_index"] is not None
    assert [[int(b == base) for b in text] for base in "ACGT"] == first["one_hot"]
    pairs = ["ACGT".find(a) * 4 + "ACGT".find(b) if "N" not in a + b else None for a, b in zip(text, text[1:])]
    assert [[0.0 if c is None else c + j for c in pairs] for j in range(12)] == first["properties"]
    wrong = shards.rows.withColumn("label", 1 - F.col("label"))
    with pytest.raises(ValueError, match="not aligned"):
        features.check_alignment(shards.rows, wrong, linked, net.nodes, params)


def test_guard_on_strands(spark, calls, tmp_path):
    one_strand = calls.filter("strand = '+'")
    with pytest.raises(ValueError, match="both strands"):
        dataset.checked_pairs(one_strand, replace(WGBS_GRCH38, chroms=CHROMS), str(tmp_path))


def test_missing_chromosome_and_no_contacts(spark, tmp_path):
    params = PRESETS["whole genome"]
    none = spark.createDataFrame([], "chrom string, bin_x bigint, bin_y bigint, count double")
    two = spark.createDataFrame([("1", 400), ("2", 100)], "raw_name string, length bigint")
    with pytest.raises(ValueError, match="missing"):
        graph.build_graph(two, none, params, str(tmp_path))
    three = two.unionByName(spark.createDataFrame([("X", 10)], two.schema))
    with pytest.raises(ValueError, match="no usable contact"):
        graph.build_graph(three, none, params, str(tmp_path))


def test_evaluate(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 500)
    scores = np.round(np.clip(labels * 0.3 + rng.random(500) * 0.7, 0, 1), 2)
    logits = (4 * scores - 2).tolist()
    rows = spark.createDataFrame(list(zip(labels.tolist(), scores.tolist(), logits)), "label int, score double, logit double")
    found = {r["metric"]: r["value"] for r in features.evaluate(rows, PRESETS["whole genome"]).collect()}
    pos, neg = scores[labels == 1], scores[labels == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert found["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    predicted = scores >= 0.5
    assert (found["tp"], found["fp"]) == ((predicted & (labels == 1)).sum(), (predicted & (labels == 0)).sum())
    assert found["best_mcc"] >= found["mcc"]
    thresholds = np.unique(scores)[::-1]
    recall = np.array([(pos >= t).mean() for t in thresholds])
    precision = np.array([labels[scores >= t].mean() for t in thresholds])
    assert found["average_precision"] == pytest.approx((np.diff(recall, prepend=0) * precision).sum())


def test_embedding_model_is_checked(spark):
    rows = spark.createDataFrame([("ACGT",)], "sequence string")
    with pytest.raises(Exception, match="shape"):
        learn.embed_windows(rows, "wrong", lambda: lambda s: np.zeros((len(s), 3)), 8).collect()
    with pytest.raises(Exception, match="non-finite"):
        learn.embed_windows(rows, "nan", lambda: lambda s: np.full((len(s), 8), np.nan), 8).collect()


def test_scores_of_a_user_model(spark):
    rows = spark.createDataFrame([([0.25, 0.5],), ([0.0, 1.0],)], "features array<double>")
    scored = learn.score_rows(rows, "mean", lambda: lambda x: np.array([np.mean(v) for v in x]))
    assert sorted(r["score"] for r in scored.collect()) == [0.375, 0.5]


def test_shards_keep_every_row_of_a_hot_split(spark):
    rows = spark.range(5000).select(
        F.lit("train").alias("split"), F.lit("chr1").alias("chrom"), F.col("id").alias("canonical_position")
    )
    shards = D.assign_shards(rows, 100).groupBy("shard_index").count().collect()
    assert len(shards) == 50 and {r["count"] for r in shards} == {100}
