"""The language model against plain counting, and its weights against plain EM."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.llm import lm

END = object()


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lower.encode().split(), END]


def counted(rows):
    word, pair = Counter(), Counter()
    for _, text, _ in rows:
        t = tokens(text)
        word.update(t)
        pair.update(zip([END, *t], t))
    return word, pair


def brute(rows, weights):
    word, pair = counted([r for r in rows if r[2] != 1])
    n, v, out = sum(word.values()), len(word), {}
    for doc_id, text, fold in rows:
        t = tokens(text)
        base = sum(math.log10((word[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = 0.0
        for h, w in zip([END, *t], t):
            a, b, c = weights[min(word[h].bit_length(), lm.LEVELS - 1)]
            score += math.log10(a * pair[h, w] / max(word[h], 1) + b * word[w] / max(n, 1) + c / (v + 1))
        out[doc_id] = (fold == 1, len(t), sum(word[w] > 0 for w in t), n, base, score)
    return out


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "Wörd", "the", "THE", "a\x0bb"]
    text = lambda n: rng.choice([" ", "\n"]).join(rng.choice(words[: rng.choice([5, 65])]) for _ in range(n))
    return [(i, text(rng.randrange(40)), i % 5) for i in range(150)] + [(150, None, 2), (151, "", 1), (152, "only unseen words here", 1)]


def scores(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, word int")
    out = lm.score_texts(frame.repartition(3, "doc_id").sortWithinPartitions("doc_id"), F.col("word"))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return {r.doc_id: tuple(r)[1:] for r in out.collect()}


def test_counts_and_scores(spark, monkeypatch):
    weights = np.array([[0.0, 0.7, 0.3], *([k / 30, 0.9 - k / 30, 0.1] for k in range(1, lm.LEVELS))])
    monkeypatch.setattr(lm, "learn_weights", lambda *a: weights)
    rows = corpus()
    found, expected = scores(spark, rows), brute(rows, weights)
    assert found.keys() == expected.keys()
    for k in expected:
        assert found[k][:4] == expected[k][:4]
        assert found[k][4:] == pytest.approx(expected[k][4:], rel=1e-12)


def test_weights_are_those_of_plain_em(spark, monkeypatch):
    seen = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: seen.setdefault("table", learn(*a)))
    rows = corpus()
    scores(spark, rows)
    word, pair = counted([r for r in rows if r[2] in (2, 3, 4)])
    v = len(counted([r for r in rows if r[2] != 1])[0])
    events = []
    for _, text, fold in rows:
        if fold == 0:
            t = tokens(text)
            events += [
                (min(word[h].bit_length(), lm.LEVELS - 1), pair[h, w] / max(word[h], 1), word[w] / sum(word.values()))
                for h, w in zip([END, *t], t)
            ]
    level, first, second = map(np.array, zip(*events))
    plain = learn(level, np.ones(len(level)), first, second, 1 / (v + 1))
    assert np.abs(seen["table"] - plain).max() < 0.05
    assert np.allclose(seen["table"].sum(axis=1), 1) and (seen["table"][:, 2] > 0).all()


def test_em_finds_the_mixture():
    rng = np.random.default_rng(0)
    pair, word = rng.random(4000), rng.random(4000)
    n = 0.6 * pair + 0.3 * word + 0.1 * 0.5
    weights = lm.learn_weights(np.full(4000, 3), 1000 * n, pair, word, 0.5)
    fine = np.array([[a, b, 1 - a - b] for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)])
    best = max(fine, key=lambda x: (n * np.log(x[0] * pair + x[1] * word + x[2] * 0.5 + 1e-12)).sum())
    assert np.abs(weights[3] - best).max() < 0.06


def test_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_corner_cases(spark):
    assert scores(spark, []) == {}
    none = scores(spark, [(1, "a b", 1), (2, None, 1)])
    assert none == {1: (True, 3, 0, 0, 0.0, 0.0), 2: (True, 1, 0, 0, 0.0, 0.0)}
    rows = spark.createDataFrame([(None, "a", None), (1, "a", 2), (1, "a", 2), (3, "q " * 300_000, 1)], "doc_id long, text string, f int")
    out = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in lm.score_texts(rows.coalesce(1), F.col("f")).collect())
    assert out == [(0, 2, 2, 6), (1, 2, 2, 6), (1, 2, 2, 6), (3, 300_001, 1, 6)]


def test_packing():
    for x in ([], [0], [255, 0], [256, 1 << 40], [(1 << 64) - 1]):
        assert lm.unpack(lm.pack(np.array(x, np.uint64))).tolist() == x
        if x:
            assert lm.unpack_sorted(lm.pack_sorted(np.sort(np.array(x, np.uint64)))).tolist() == sorted(x)
