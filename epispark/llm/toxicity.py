"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.words import ALPHANUMERIC, placed_words, slices, text_bytes

#: A sentence ends with one of these bytes, or with the text.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 33, 46, 63]] = True
#: Beside a word itself, its first so many bytes are features.
PREFIXES = (3, 4, 5, 6)


@dataclass(frozen=True)
class SentenceModel:
    """Weights of ``features`` (sorted hashes) and a bias: the log-odds that a sentence offends."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sentences(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each word its row, the number of its sentence (over all texts), its place and its features."""
    rows, places, features = placed_words(offsets, data, ALPHANUMERIC, PREFIXES)
    if not len(rows):
        return rows, places, places, features
    ends = np.flatnonzero(_ENDS[data[offsets[0] : offsets[-1]]]) + offsets[0]
    number = np.searchsorted(ends, places) + rows
    return rows, number, places, features


def _found(features: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that have one of the ``known`` features, and which."""
    word, which = [], []
    for values in features:
        at = np.minimum(np.searchsorted(known, values), len(known) - 1) if len(known) else np.zeros(0, int)
        hit = np.flatnonzero(known[at] == values) if len(known) else at
        word.append(hit)
        which.append(at[hit])
    return np.concatenate(word), np.concatenate(which)


def _bags(part: pa.RecordBatch, known: np.ndarray):
    """Sentences per text, and for each (text, sentence, feature) that occurs: text, sentence, feature."""
    rows, number, _, features = _sentences(*text_bytes(part.column("_text")))
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = number[1:] != number[:-1]
    counts = np.bincount(rows[fresh], minlength=part.num_rows)
    word, which = _found(features, known)
    pairs = np.unique(np.stack([number[word], which, rows[word]]), axis=1) if len(word) else np.zeros((3, 0), int)
    return counts, pairs[2], pairs[0], pairs[1]


def _labelled(docs: DataFrame, labels: DataFrame, learned: Column, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """Texts and labels of at most ``sample`` documents that there are, those with the smallest hashes.
    Of rows with one id and unlike texts the smallest text is taken."""
    there = docs.select(F.col(doc_id).alias("_id")).distinct()
    chosen = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y"), learned.alias("_in")).dropna()
        .filter("_in").join(there, "_id", "left_semi").groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
        .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample)
    )
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))


def _select(train: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The ``size`` features whose shares among the two kinds of documents differ most surely."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                rows, _, _, features = _sentences(*text_bytes(part.column("_text")))
                y = part.column("_y").to_numpy()
                for values in features:
                    seen = np.unique(np.stack([rows[values > 0].astype(np.uint64), values[values > 0]]), axis=1)
                    each, where = np.unique(seen[1], return_inverse=True)
                    positive = np.bincount(where, weights=y[seen[0].astype(np.int64)], minlength=len(each))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(each.view(np.int64)), pa.array(np.bincount(where, minlength=len(each))),
                        pa.array(positive.astype(np.int64)),
                    ], ["feature", "n", "pos"])

    sums = train.agg(F.count("*").alias("n"), F.sum("_y").alias("pos")).first()
    n, pos = sums.n, sums.pos or 0
    if not 0 < pos < n:
        return np.zeros(0, np.uint64), pos
    share = F.col("n") / n
    apart = (F.col("pos") / pos - (F.col("n") - F.col("pos")) / (n - pos)) / F.sqrt(share * (1 - share) + 1.0 / n)
    best = (
        train.mapInArrow(count, "feature long, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        .filter("n >= 4").orderBy(F.abs(apart).desc(), "feature").limit(size).select("feature").toArrow()
    )
    return np.sort(best.column(0).to_numpy().view(np.uint64)), pos


def fit_noisy_or(
    labels: np.ndarray, counts: np.ndarray, text: np.ndarray, sentence: np.ndarray, feature: np.ndarray, size: int,
    ridge: float = 1e-3, steps: int = 600, rate: float = 0.05,
) -> tuple[np.ndarray, float]:
    """Weights and bias for which a document is 1 - product of (1 - sentence scores), by the
    likelihood of the documents' labels (Adam on all of them)."""
    kinds, where = np.unique(np.stack([text, sentence]), axis=1, return_inverse=True)
    where, owner = where.ravel(), kinds[0].astype(np.int64)
    bare = counts - np.bincount(owner, minlength=len(labels))
    w, slope, curve = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = -6.0
    for t in range(1, steps + 1):
        s = w[-1] + np.bincount(where, weights=w[feature], minlength=len(owner))
        total = np.bincount(owner, weights=_softplus(s), minlength=len(labels)) + bare * _softplus(w[-1])
        odd = np.maximum(-np.expm1(-total), 1e-12)
        by_total = np.where(labels > 0, 1 - 1 / odd, 1.0)
        by_sentence = by_total[owner] / (1 + np.exp(-s))
        g = np.append(np.bincount(feature, weights=by_sentence[where], minlength=size),
                      by_sentence.sum() + (by_total * bare).sum() / (1 + np.exp(-w[-1])))
        g = np.clip(g / len(labels), -1e3, 1e3) + ridge / max(len(labels), 1) * np.append(w[:-1], 0)
        slope, curve = 0.9 * slope + 0.1 * g, 0.999 * curve + 0.001 * g * g
        w = w - rate * (slope / (1 - 0.9**t)) / (np.sqrt(curve / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def learn_sentences(
    docs: DataFrame, labels: DataFrame, learned: Column, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", sample: int = 20_000, features: int = 1024,
) -> SentenceModel:
    """Fit on at most ``sample`` labelled documents for which ``learned`` holds.

    Two bytes for a word that is one of ``features`` (32,767 at most), and two for its sentence,
    come to the driver. Labels with a null are none; those of one document are averaged, the
    smallest of its texts counts, a null text as an empty one. Without documents of both kinds
    every document gets the same score a sentence.
    """
    if features > 32_767:
        raise ValueError("at most 32,767 features")
    train = _labelled(docs, labels, learned, doc_id, text, label, sample)
    known, positive = _select(train, features)
    if not len(known):
        return SentenceModel(known, np.zeros(0), 2.0 if positive else -20.0)

    def bag(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                counts, rows, number, which = _bags(part, known)
                fresh = np.flatnonzero(np.diff(number, prepend=-1))  # where a sentence's features begin
                sizes = np.diff(fresh, append=len(number))
                texts = np.arange(part.num_rows + 1)
                yield pa.RecordBatch.from_arrays([
                    part.column("_y"), pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(rows[fresh], texts).astype(np.int32)), pa.array(sizes.astype(np.int16))),
                    pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(rows, texts).astype(np.int32)), pa.array(which.astype(np.int16))),
                ], ["y", "counts", "sizes", "feature"])

    got = train.mapInArrow(bag, "y int, counts long, sizes array<short>, feature array<short>").toArrow().combine_chunks()
    sizes, feature = (got.column(c).combine_chunks() for c in ("sizes", "feature"))
    each = sizes.flatten().to_numpy()
    weights, bias = fit_noisy_or(
        got.column("y").to_numpy(), got.column("counts").to_numpy(),
        np.repeat(np.arange(len(feature)), feature.value_lengths().to_numpy()), np.repeat(np.arange(len(each)), each),
        feature.flatten().to_numpy(), len(known),
    )
    return SentenceModel(known, weights, bias)


def _located(raw: np.ndarray, places: np.ndarray, scores: np.ndarray) -> list[dict]:
    """Bounds in code points of the sentences that begin with the words at ``places``."""
    stops = np.flatnonzero(_ENDS[raw])
    edges = np.concatenate([[0], stops + 1, [len(raw)]])
    points = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
    at = np.searchsorted(stops, places)
    return [
        {"start": a, "end": b, "score": x}
        for a, b, x in zip(points[edges[at]].tolist(), points[edges[at + 1]].tolist(), scores.tolist())
    ]


_SPOTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score_toxicity(
    docs: DataFrame, model: SentenceModel, doc_id: str = "doc_id", text: str = "text", least: float = 0.5
) -> DataFrame:
    """``doc_id``, ``score`` and ``offending`` (start, end, score) of every whole text.

    A sentence's score is the logistic of the weights of its words and their beginnings; the
    document's is the noisy-or of its sentences. Offending are the sentences that score
    ``least`` or more, bounds in code points, the end exclusive.

    One row per row of ``docs``, repeated ones included. Null and empty texts have no
    sentences and score 0. Other columns are ignored.
    """

    def score(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                offsets, data = text_bytes(part.column("_text"))
                rows, number, places, features = _sentences(offsets, data)
                fresh = np.ones(len(rows), dtype=bool)
                fresh[1:] = number[1:] != number[:-1]
                head = np.flatnonzero(fresh)
                word, which = _found(features, model.features)
                own = np.cumsum(fresh) - 1
                pairs = np.unique(np.stack([own[word], which]), axis=1) if len(word) else np.zeros((2, 0), int)
                odds = model.bias + np.bincount(pairs[0], weights=model.weights[pairs[1]], minlength=len(head))
                total = np.bincount(rows[head], weights=_softplus(odds), minlength=part.num_rows)
                chance = 1 / (1 + np.exp(-odds))
                spots = [[] for _ in range(part.num_rows)]
                bad = np.flatnonzero(chance >= least)
                for row in np.unique(rows[head[bad]]):
                    mine = bad[rows[head[bad]] == row]
                    spots[row] = _located(
                        data[offsets[row] : offsets[row + 1]], places[head[mine]] - offsets[row], chance[mine])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(-np.expm1(-total)), pa.array(spots, _SPOTS)], ["_id", "score", "offending"])

    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = dict(picked.dtypes)["_id"]
    schema = f"_id {kind}, score double, offending array<struct<start:bigint,end:bigint,score:double>>"
    return picked.mapInArrow(score, schema).withColumnRenamed("_id", doc_id)
