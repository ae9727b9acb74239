"""Quality scores: held-out accuracy, the site posteriors by hand, corner cases."""

import math

import numpy as np
import pyarrow as pa

from epispark.llm import quality

FOLDER = "/root/testdata/sf0.01"
SITE = ("source", "lang")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    learned, held = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    rows = quality.score_quality(docs, learned, *SITE).join(held, "doc_id").collect()
    assert len(rows) > 100
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    kept = quality.keep_quality(docs, learned, *SITE)
    assert kept.schema == docs.schema
    expected = quality.score_quality(docs, learned, *SITE).filter("kept")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in expected.collect())


def test_posteriors_by_hand(spark):
    texts = {"good": "plain words that differ from one another", "bad": "SPAM!! SPAM!! SPAM!! SPAM!!"}
    docs, labels = [], []
    for i in range(120):
        kind = "bad" if i % 4 == 0 or (i % 3 == 0 and i % 5) else "good"
        docs.append((i, f"{texts[kind]} {'x' * (i % 7)}", f"h{i % 3}", f"p{i % 5}"))
        labels.append((i, int(kind == "good")))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    rows = quality.score_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"), *SITE).collect()
    p = {r.doc_id: r.text_score for r in rows}
    site = {d[0]: (d[2], d[3]) for d in docs}

    def sums(key):
        out = {}
        for i, x in p.items():
            n, s, q = out.get(key(i), (0, 0.0, 0.0))
            out[key(i)] = (n + 1, s + x, q + x * x)
        return out

    def strength(groups):
        g, n = len(groups), sum(v[0] for v in groups.values())
        mean = sum(v[1] for v in groups.values()) / n
        between = sum(v[1] ** 2 / v[0] for v in groups.values())
        within = (sum(v[2] for v in groups.values()) - between) / (n - g)
        spread = (between - n * mean**2 - (g - 1) * within) / (n - sum(v[0] ** 2 for v in groups.values()) / n)
        return mean, max(mean * (1 - mean) / spread - 1, 1) if spread > 1e-9 else 1e6

    hosts, paths = sums(lambda i: site[i][0]), sums(lambda i: site[i])
    # Paths around their own host's mean, one host after the other.
    inside = expected = kept = odd = 0.0
    within = sum(q - s * s / n for n, s, q in paths.values()) / (len(p) - len(paths))
    for h, (n, s, _) in hosts.items():
        own = [v for (name, _), v in paths.items() if name == h]
        inside += sum(m * (t / m - s / n) ** 2 for m, t, _ in own)
        expected += (len(own) - 1) * within
        kept += n - sum(m * m for m, _, _ in own) / n
        odd += n * (s / n) * (1 - s / n)
    spread = (inside - expected) / kept
    b = max(odd / len(p) / spread - 1, 1) if spread > 1e-9 else 1e6
    prior, a = strength(hosts)
    odds = lambda x: math.log(x / (1 - x))
    for r in rows:
        n, s, _ = hosts[site[r.doc_id][0]]
        host = (s - p[r.doc_id] + a * prior) / (n - 1 + a)
        n, s, _ = paths[site[r.doc_id]]
        path = (s - p[r.doc_id] + b * host) / (n - 1 + b)
        assert math.isclose(r.host_score, host, rel_tol=1e-6) and math.isclose(r.path_score, path, rel_tol=1e-6)
        score = 1 / (1 + math.exp(-(odds(p[r.doc_id]) + odds(path) - odds(prior))))
        assert math.isclose(r.score, score, rel_tol=1e-5, abs_tol=1e-9) and r.kept == (r.score >= 0.5)


def test_corner_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, None, "x", 1.0), (1, "", "a", None, 2.0), (None, "q " * 300_000, "a", "x", 3.0), (4, "A b", "a", "x", 4.0)] * 2,
        "doc_id long, text string, source string, lang string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_quality(docs, none, *SITE).collect()
    assert len(rows) == 8 and all(r.kept and 0 <= r.score <= 1 for r in rows)
    one = spark.createDataFrame([(4, 0), (4, 0)], "doc_id long, quality int")
    assert not any(r.kept for r in quality.score_quality(docs, one, *SITE).collect())
    assert quality.keep_quality(docs, none, *SITE).count() == 8
    assert quality.score_quality(docs.limit(0), one, *SITE).count() == 0
    assert quality.keep_quality(docs.limit(0), one, *SITE).count() == 0


def test_features_of_an_empty_text():
    part = pa.RecordBatch.from_pydict({"t": ["", None, " \n"]})
    assert not quality.text_features(part, "t").any()
