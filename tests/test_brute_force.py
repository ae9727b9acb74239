"""Graph, pooling and row numbers against plain NumPy, with one key holding much of the data."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epispark.functions import sequence as S
from epispark.operators import calls as C
from epispark.operators import genome as G
from epispark.operators import graph as H
from epispark.operators import indexing as I
from epispark.operators import nodes as N
from epispark.operators import splits as X

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("seed", range(3))
def test_graph(spark, seed):
    rng = np.random.default_rng(seed)
    n, k, cap = 14, 3, 9
    x, y = rng.integers(0, n, 300), rng.integers(0, n, 300)
    x[:100], y[:100] = 4, 5
    w = rng.integers(0, 6, 300).astype(float)
    dense, seen = np.zeros((n, n)), np.zeros((n, n), bool)
    for a, b, v in zip(x, y, w):
        if abs(a - b) <= cap:
            for i, j in {(a, b), (b, a)}:
                dense[i, j] += v
                seen[i, j] = True
    kept = np.zeros((n, n))
    for i in range(n):
        for j in sorted(np.flatnonzero(seen[i]), key=lambda j: (-dense[i, j], j))[:k]:
            kept[i, j] = dense[i, j]
    kept = np.maximum(kept, kept.T)
    rows = [("c", int(a), int(b), float(v)) for a, b, v in zip(np.minimum(x, y), np.maximum(x, y), w)]
    contacts = spark.createDataFrame(rows, "chrom string, bin_x bigint, bin_y bigint, count double")
    nodes = H.node_index(spark.createDataFrame([("c", n * 10)], "chrom string, length bigint"), 10, ["c"])
    edges = H.topk_union(H.symmetric_edges(H.near_contacts(contacts, cap), H.chrom_offsets(nodes)), k)
    found = {(r["src"], r["dst"]): r["weight"] for r in edges.collect()}
    assert found == {(i, j): kept[i, j] for i, j in zip(*np.nonzero(kept))}

    distance = {key: abs(key[0] - key[1]) for key in found}
    mean = {d: np.mean([found[key] for key in found if distance[key] == d]) for d in set(distance.values())}
    features = H.edge_features(edges, nodes, 10, cap).filter("is_self_loop = 0").collect()
    assert len(features) == len(found)
    for r in features:
        key = (r["src"], r["dst"])
        assert r["observed_expected"] == pytest.approx(found[key] / mean[distance[key]], rel=1e-6)
        assert r["log_count"] == pytest.approx(np.log1p(found[key]), rel=1e-6)
        assert r["log_distance"] == pytest.approx(np.log1p(distance[key] * 10), rel=1e-6)


def test_neighbour_mean(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6, 4))
    pairs = [(s, d) for s in range(6) for d in range(6) if s == d or rng.random() < 0.5] 
    scores = rng.normal(size=len(pairs)) * 300
    edges = spark.createDataFrame([(s, d, float(v)) for (s, d), v in zip(pairs, scores)], "src bigint, dst bigint, score double")
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "node_index bigint, features array<double>")
    found = {r["dst"]: r["embedding"] for r in N.neighbour_aggregate(edges, features, "score", 50).collect()}
    for d in range(6):
        into = [(s, v) for (s, t), v in zip(pairs, scores) if t == d]
        e = np.exp(np.array([v for _, v in into]) - max(v for _, v in into))
        wanted = (e[:, None] * vectors[[s for s, _ in into]]).sum(0) / e.sum()
        assert found[d] == pytest.approx(wanted.tolist(), rel=1e-9)


def test_pooling_with_a_hot_bin(spark):
    rng = np.random.default_rng(2)
    bins = np.where(rng.random(3000) < 0.5, 0, rng.integers(0, 40, 3000))
    vectors = rng.normal(size=(3000, 5)).astype(np.float32)
    rows = [("c", int(b), v.tolist()) for b, v in zip(bins, vectors)]
    windows = spark.createDataFrame(rows, "chrom string, bin_start int, embedding array<float>").repartition(6)
    found = {r["bin_start"]: r for r in N.pool_embeddings(windows).collect()}
    for b in set(bins.tolist()):
        assert found[b]["sample_count"] == (bins == b).sum()
        assert found[b]["embedding"] == pytest.approx(vectors[bins == b].astype(float).mean(0).tolist(), abs=1e-9)


def test_consensus_with_a_hot_site(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(1, 3)), "chr1", 50 if rng.random() < 0.4 else int(rng.integers(0, 30)), "+",
             int(rng.integers(0, 9)), float(rng.integers(0, 101))) for _ in range(3000)]
    calls = spark.createDataFrame(rows, "rep int, chrom string, chrom_start bigint, strand string, coverage bigint, percent_methylated double")
    sums = Counter()
    for rep, _, start, _, coverage, percent in rows:
        m = int(np.round(coverage * percent / 100.0))
        sums[start + 1, rep, "m"] += m
        sums[start + 1, rep, "u"] += coverage - m
    paired = {r["canonical_position"]: r for r in C.pair_replicates(C.stranded_counts(calls, ["chr1"])).collect()}
    assert paired[51]["strand_row_count_rep1"] > 300
    for position, r in paired.items():
        for rep in (1, 2):
            assert (r[f"count_m_rep{rep}"] or 0, r[f"count_u_rep{rep}"] or 0) == (sums[position, rep, "m"], sums[position, rep, "u"])


@QUIET
@given(st.text("ACGTNYacgt", max_size=60), st.integers(3, 12))
def test_windows_and_codes(spark, text, width):
    window = 5
    contigs = spark.createDataFrame([("c", text)], "chrom string, seq string")
    tiles = G.tile_contigs(contigs, width, window // 2)
    sites = spark.range(-1, 64).select(F.lit("c").alias("chrom"), F.col("id").alias("canonical_position"))
    found = G.site_windows(sites, tiles, width, window)
    upper = text.upper()
    for r in found.withColumn("codes", S.base_codes(F.col("sequence"))).collect():
        start = r["canonical_position"] - 3
        wanted = upper[start : start + 5] if start >= 0 and start + 5 <= len(text) else None
        assert r["sequence"] == wanted
        assert r["codes"] == (None if wanted is None else ["ACGT".find(b) if b in "ACGT" else 4 for b in wanted])


@QUIET
@given(st.dictionaries(st.sampled_from([f"chr{i}" for i in range(12)]), st.integers(1, 50), min_size=1))
def test_greedy_split(spark, counts):
    rows = spark.createDataFrame(list(counts.items()), "chrom string, site_count bigint")
    total, filled, wanted = sum(counts.values()), dict(train=0, validation=0, test=0), {}
    shares = dict(train=0.8, validation=0.1, test=0.1)
    for chrom, n in sorted(counts.items(), key=lambda item: (-item[1], item[0])):
        split = max(shares, key=lambda s: total * shares[s] - filled[s])
        wanted[chrom], filled[split] = split, filled[split] + n
    assert {r["chrom"]: r["split"] for r in X.greedy_split(rows).collect()} == wanted


@QUIET
@given(st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 10**6)), min_size=1, max_size=200, unique=True))
def test_row_index_per_group(spark, keys):
    rows = spark.createDataFrame(keys, "g string, v bigint").repartition(5)
    found = {(r["g"], r["v"]): r["row_index"] for r in I.with_row_index(rows, ["v"], [F.floor(F.col("v") / 1000), F.col("v") % 1 + F.floor(F.col("v") / 10)], group="g").collect()}
    for g in {g for g, _ in keys}:
        ordered = sorted(v for h, v in keys if h == g)
        assert [found[g, v] for v in ordered] == list(range(len(ordered)))
