"""Toxicity: the sentence model against a plain computation, held-out accuracy, corner cases."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from epispark.llm import toxicity, workload

FOLDER = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    rows = workload.QUERIES["op3_toxicity"](spark, FOLDER)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = rows.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(found) > 80
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.9
    positive, negative = ([r.score for r in found if r.toxic == k] for k in (1, 0))
    assert np.mean([[p > n for n in negative] for p in positive]) > 0.9
    assert rows.count() == 1000


def _plain(text, model, base):
    """Sentences one by one, words by a regular expression, hashes by the shared helper."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    at, total, spots = 0, 0.0, []
    for m in re.finditer(r"[^.!?\n]*(?:[.!?\n]|$)", lower):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", m.group())
        if words:
            known = {f for w in words for f in base(w) if f in model}
            odds = model[None] + sum(model[f] for f in known)
            total += math.log1p(math.exp(odds))
            if odds >= 0:
                spots.append((m.start(), m.end()))
        at = m.end()
    return 1 - math.exp(-total), spots


def test_scores_and_spots_by_hand(spark):
    def features(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        _, _, hashes = toxicity.placed_words(np.array([0, len(raw)]), raw, toxicity.ALPHANUMERIC, toxicity.PREFIXES)
        return {int(h[0]) for h in hashes if h[0]}

    words = ["bad", "badly", "né", "ok", "veju", "vejune", "x"]
    weights = {f: (-1) ** k * 1.3 * (k + 1) for k, w in enumerate(words) for f in features(w)}
    known = np.array(sorted(weights), np.uint64)
    model = toxicity.SentenceModel(known, np.array([weights[int(f)] for f in known]), -2.0)
    texts = ["", "Bad. ok bad! né BADLY\nx veju", "no end", "né né. vejunes? bad bad", "...", "É vejun bad " * 50, None]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, t in enumerate(texts):
        score, spots = _plain(t or "", weights | {None: -2.0}, features)
        assert math.isclose(rows[i].score, score, abs_tol=1e-12)
        assert [(s.start, s.end) for s in rows[i].offending] == spots


def test_learning_from_bags():
    rng = np.random.default_rng(0)
    labels, counts, text, sentence, feature = [], [], [], [], []
    for k in range(400):
        labels.append(int(rng.random() < 0.3))
        counts.append(6)
        for s in range(6):
            words = list(rng.integers(1, 20, 3)) + ([0] if labels[-1] and s == 2 else [])
            for f in set(words):
                text.append(k), sentence.append(s), feature.append(f)
    args = [np.array(x) for x in (labels, counts, text, sentence, feature)]
    weights, bias = toxicity.fit_noisy_or(*args, 20)
    assert weights[0] + bias > 1 and (weights[1:] + bias < -1).all()


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b. c", 1), (2, None, 2), (None, "x", 3)], "doc_id long, text string, _y int")
    for labels, low, high in (([(1, 1)], 0.8, 1), ([(1, 0), (1, 0)], 0, 1e-3), ([], 0, 1e-3), ([(2, None), (None, 1)], 0, 1e-3)):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = toxicity.learn_sentences(docs, frame, F.lit(True))
        rows = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
        assert low <= rows[1] <= high and rows[2] == 0 and len(rows) == 3
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, "vile words" if i % 2 else "kind words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    rows = toxicity._labelled(docs, labels, F.lit(True), "doc_id", "text", "toxic", 40).collect()
    assert sorted(r._id for r in rows) == list(range(40))
