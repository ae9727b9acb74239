"""Ranked search against SQL on the given tables and plain scores on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from epispark.llm import search, workload

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def plain(docs, items, k=10):
    found = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, counts), size in zip(found, sizes):
            score = 0
            for t in set(words(text)) & set(counts):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * counts[t] // (1000 * counts[t] + 8 * (10 + 90 * size * n // length)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **more):
    docs = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, row long, term int, score int")
    items = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, row int")
    return sorted(map(tuple, search.rank_documents(docs.repartition(3), items, **more).collect()), key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_matches_sql(spark, folder):
    found = workload.op12_lexical_search(spark, folder)
    assert difference(found, connect(folder), workload.ORACLES["op12_lexical_search"]) is None


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 30)))) for i in range(n)]
    docs += [(n + i, docs[3][1].upper()) for i in range(40)]  # ties
    docs += [(None, docs[5][1]), (None, None), (3, docs[3][1]), (-1, ""), (-2, "Ünï " * 20_000 + "w1"), (-3, "w59")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(12)]
    return docs, items + [(50, None), (51, ""), (52, "nowhere"), (53, "W1, w1; ünï-ÜnÏ"), (None, "w2 w3"), (54, docs[3][1])]


def test_odd_rows_in_several_passes_and_segments(spark, monkeypatch):
    docs, items = corpus(1, 300)
    want = plain(docs, items)
    assert ranked(spark, docs, items) == want
    monkeypatch.setattr(search, "ITEM_TERMS", 40)
    assert ranked(spark, docs, items, k=10) == want
    assert ranked(spark, docs, items, k=3) == plain(docs, items, 3)


def test_repeated_items_and_empty_tables(spark):
    docs, items = corpus(2, 30)
    assert ranked(spark, docs, items[:1] * 2) == sorted(plain(docs, items[:1]) * 2, key=repr)
    assert ranked(spark, [], items) == [] == ranked(spark, docs, [])
    assert ranked(spark, [(1, ""), (2, None)], items) == []


def test_limits_are_never_below_scores_and_skip_blocks(monkeypatch):
    """Blocks of any list bound every document in them over the terms not yet read, and some are skipped."""
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = np.random.default_rng(3)
    n, terms = 200, 50
    held = rng.random((n, terms)) < 0.15
    held[:, 0] |= True
    values = rng.integers(1, 1000, (n, terms)) * held
    bounds = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
    weights = rng.integers(1, 500, terms)
    items = [np.sort(rng.choice(terms, 8, replace=False)) for _ in range(20)]
    items = [i[np.argsort(-weights[i], kind="stable")] for i in items]
    asked = search.Asked(np.arange(terms), weights, np.arange(20), np.arange(0, 161, 8), np.concatenate(items))
    segment = search.Segment(pa.array(range(n)), bounds, np.nonzero(held)[1].astype(np.int32), values[held])
    segment.summarise(asked)
    judged = 0
    plain_scores = segment.scores
    for k, item in enumerate(items):
        own = search._item_weights(asked, k)
        scores = values @ own
        for j, term in enumerate(item):
            limits = segment.limits(item[j:], weights[item[j:]])
            rest = values[:, item[j:]] @ weights[item[j:]]
            docs = segment.listed(int(term))
            assert (np.repeat(limits, 4)[:len(docs)] >= rest[docs]).all()
        order = sorted(range(n), key=lambda d: (-scores[d], d))[:5]
        seen = []
        segment.scores = lambda docs, w: (seen.append(len(docs)), plain_scores(docs, w))[1]
        ids, best = segment.search(asked, k, own, 5, int(scores[order[4]]))
        assert sorted(ids.to_pylist()) == sorted(order)
        assert (scores[ids.to_pylist()] == best).all()
        judged += sum(seen)
    assert judged < 0.5 * 20 * n


def test_k_best_with_string_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "same words here") for i in range(30)], "doc_id string, text string")
    items = spark.createDataFrame([("q", "here words other")], "item_id string, text string")
    got = search.rank_documents(docs.repartition(4), items.withColumn("rank", F.lit(0))).orderBy("rank").collect()
    assert [r.doc_id for r in got] == sorted(f"d{i}" for i in range(30))[:10]
