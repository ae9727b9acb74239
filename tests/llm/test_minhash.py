"""Near-duplicate linking against all pairs compared by brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from epispark.llm import minhash
from epispark.llm.groups import in_blocks
from epispark.llm.links import components


def shingle_set(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, size, percent=80):
    sets = [shingle_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)], low[find(i)] == d) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def found(spark, docs, **more):
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, n_shingles int, key string")
    return sorted((tuple(r) for r in minhash.link_near_duplicates(df, **more).collect()), key=lambda r: repr(r))


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


@pytest.fixture
def texts():
    rng = random.Random(2)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 25])):
            out.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))))
    return out


def test_all_pairs(spark, texts, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    docs = list(enumerate(texts))
    random.Random(4).shuffle(docs)
    for size in (4, 5):
        assert found(spark, docs, shingle=size) == sorted(brute(docs, size), key=repr)


def test_corner_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "b a"), (7, "q " * 300_000), (8, "Q"), (9, "q q q q q")]
    assert found(spark, docs) == sorted(brute(docs, 4), key=repr)
    nulls = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None)]
    assert found(spark, nulls) == [(3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True), (None, 2, None, True)]
    assert found(spark, []) == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b = minhash.signature(values[:800], 2000), minhash.signature(values[100:], 2000)
    assert abs(np.mean(a == b) - 700 / 900) < 0.04


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(9)
    nodes = rng.sample(range(1000), 300)
    path = list(zip(nodes[:100], nodes[1:101]))
    star = [(nodes[110], n) for n in nodes[111:200]]
    edges = path + star + [(nodes[250], nodes[250]), (nodes[1], nodes[0]), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(nodes[:101]) for n in nodes[:101]} | {n: min(nodes[110:200]) for n in nodes[110:200]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_thousands_of_rows_with_one_id(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(minhash, "in_blocks", lambda rows, *a: sizes.append(rows.count()) or in_blocks(rows, *a))
    base = [f"w{i}" for i in range(60)]
    docs = [(7, " ".join(base))] * 4000 + [(3, " ".join([*base, "more"]))] + [(9, " ".join([*base, f"v{i}"])) for i in range(30)]
    got = found(spark, docs)
    assert {(d, c, k) for d, _, c, k in got if d != 9} == {(7, 3, False), (3, 3, True)} and len(got) == len(docs)
    assert all(c == 3 for _, _, c, _ in got) and sizes[0] <= 40 * 32


def test_little_is_stored_and_moved_for_a_text(spark, monkeypatch):
    kept, own = {}, minhash.saved
    monkeypatch.setattr(minhash, "saved", lambda df, name: kept.setdefault(name, own(df, name)))
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = [(i, " ".join(edited(rng, base, 0.01 * (i % 3)))) for i in range(400)]
    assert found(spark, [*docs, docs[7]]) == sorted([*brute(docs, 4), brute(docs, 4)[7]], key=repr)
    signed = sum(os.path.getsize(f.removeprefix("file://")) for f in kept["signed"].inputFiles())
    assert "bands" not in kept["signed"].columns + kept["members"].columns and signed < 300 * len(docs)
    often = {r.doc_id for r in kept["clusters"].filter("often").collect()}
    assert often == {7} & {r.doc_id for r in kept["clusters"].collect()} and kept["clusters"].count() > 100


def test_bands_are_the_low_bytes_of_their_rows():
    low = np.random.default_rng(3).integers(0, 1 << 32, (3, minhash.ROWS * minhash.BANDS)).astype(np.uint32)
    low[1, 5:10] = low[0, 5:10]
    marks = [x.astype(np.uint8).tobytes() for x in low]
    (rows,) = minhash._bands([pa.record_batch({"set": pa.array([4, 5, 6]), "marks": pa.array(marks, pa.binary())})])
    band = rows.column("band").to_numpy().reshape(3, minhash.BANDS)
    assert rows.column("set").to_pylist() == [s for s in (4, 5, 6) for _ in range(minhash.BANDS)]
    assert np.flatnonzero(band[0] == band[1]).tolist() == [1] and len(np.unique(band)) == 3 * minhash.BANDS - 1
    assert band[2, 39] == (39 << 40) + int.from_bytes(marks[2][195:], "little")
