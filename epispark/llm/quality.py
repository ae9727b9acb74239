"""Quality of documents: a text classifier, and what its verdicts say about hosts and paths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.store import saved
from epispark.llm.words import SPACED, hashed_words, slices, text_bytes, word_ranges

FEATURES = (
    "words", "word_length", "distinct_words", "distinct_pairs", "repeats", "upper", "digits", "marks", "exclamations",
    "symbols", "beyond_ascii", "lines", "repeated_lines",
)
_SIGNS = {
    "exclamations": b"!?", "symbols": b"#$%&*+<=>@[]^_`{|}~\\/", "marks": b".,;:'\"()-",
}
_SIGNS = {k: np.frombuffer(v, np.uint8) for k, v in _SIGNS.items()}


def text_features(part: pa.RecordBatch, text: str) -> np.ndarray:
    """A row of ``FEATURES`` for every whole text: sizes as logarithms, the rest as shares."""
    offsets, data = text_bytes(part.column(text))
    rows, hashes = hashed_words(offsets, data, SPACED)
    starts = word_ranges(rows, part.num_rows)
    out = np.zeros((part.num_rows, len(FEATURES)), dtype=np.float32)
    for k in range(part.num_rows):
        raw, words = data[offsets[k] : offsets[k + 1]], hashes[starts[k] : starts[k + 1]]
        n = len(words)
        if not n:
            continue
        held = np.bincount(raw, minlength=256)
        upper, letters = held[65:91].sum(), held[65:91].sum() + held[97:123].sum() + held[128:].sum()
        ink = len(raw) - held[9:14].sum() - held[32]
        lines = raw.tobytes().split(b"\n")
        pairs = words[1:] + words[:-1] * np.uint64(0x9E3779B97F4A7C15)
        out[k] = (
            np.log1p(n), ink / n, len(np.unique(words)) / n, (len(np.unique(pairs)) + 1) / n,
            (words[1:] == words[:-1]).sum() / n, upper / max(letters, 1), held[48:58].sum() / ink,
            held[_SIGNS["marks"]].sum() / ink, held[_SIGNS["exclamations"]].sum() / ink,
            held[_SIGNS["symbols"]].sum() / ink, held[128:].sum() / ink, np.log1p(len(lines)),
            1 - len(set(lines)) / len(lines),
        )
    return out


@dataclass(frozen=True)
class Classifier:
    """A sum over the features of one weight for the bin that a value falls into."""

    edges: np.ndarray
    weights: np.ndarray

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, side="left") for e, v in zip(self.edges, values.T)], axis=1)

    def evidence(self, values: np.ndarray) -> np.ndarray:
        bins, width = self.bins(values), self.edges.shape[1] + 1
        return self.weights[0] + self.weights[1 + bins + np.arange(bins.shape[1]) * width].sum(axis=1)


def fit_classifier(values: np.ndarray, labels: np.ndarray, bins: int = 10, ridge: float = 1.0) -> Classifier:
    """Penalised logistic regression on binned features, by Newton's method.

    With labels of one kind only, or none, the weights say nothing but that kind (none: good).
    """
    width, n = bins, values.shape[1]
    edges = np.zeros((n, bins - 1))
    weights = np.zeros(1 + n * width)
    if not len(labels) or labels.min() == labels.max():
        weights[0] = 10.0 if not len(labels) or labels[0] > 0 else -10.0
        return Classifier(edges, weights)
    edges = np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T.astype(np.float32)
    model = Classifier(edges, weights)
    x = np.zeros((len(values), len(weights)), dtype=np.float32)
    x[:, 0] = 1
    x[np.arange(len(values))[:, None], 1 + model.bins(values) + np.arange(n) * width] = 1
    penalty = np.full(len(weights), ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ weights)))
        slope = x.T @ (labels - p) - penalty * weights
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), slope)
        weights = weights + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(edges, weights)


def site_columns(host: str, path: str) -> list[Column]:
    """Host and path as texts that are never null; a missing host is a site of its own."""
    return [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path")]


def _described(docs: DataFrame, text: str, doc_id: str, host: str, path: str) -> DataFrame:
    def describe(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                values = text_features(part, "_text")
                made = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], made], [*part.schema.names[:3], "_values"])

    picked = docs.select(F.col(doc_id).alias("_id"), *site_columns(host, path), F.col(text).alias("_text"))
    kind = dict(picked.dtypes)["_id"]
    return picked.mapInArrow(describe, f"_id {kind}, _host string, _path string, _values array<float>")


def _learned(described: DataFrame, labels: DataFrame, doc_id: str, label: str, sample: int) -> Classifier:
    """Fitted on ``sample`` labelled documents at most, those with the smallest hashes."""
    known = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).dropna()
        .groupBy("_id").agg((F.avg("_y") >= 0.5).cast("double").alias("_y"))
    )
    rows = (
        described.join(known, "_id").select(F.xxhash64(F.col("_id").cast("string")).alias("_h"), "_values", "_y")
        .orderBy("_h", "_values").limit(sample).toArrow()
    )
    values = rows.column("_values").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit_classifier(values, rows.column("_y").to_numpy())


def _scored(model: Classifier):
    def score(batches):
        for batch in batches:
            values = batch.column("_values").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(model.evidence(values))], [*batch.schema.names[:3], "_evidence"])

    return score


def _probability(evidence: Column) -> Column:
    return 1 / (1 + F.exp(-evidence))


def _evidence(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """The mean, and how many documents the prior of a group is worth, from the spread of
    the groups' means beyond what chance explains."""
    g = groups.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not g.n:
        return 0.5, 1e6
    mean = min(max(g.s / g.n, 1e-6), 1 - 1e-6)
    within = max(g.q - g.between, 0.0) / max(g.n - g.g, 1)
    spread = (g.between - g.n * mean * mean - (g.g - 1) * within) / max(g.n - g.nn / g.n, 1e-9)
    return mean, min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 1e-9 else 1e6


def _nested_strength(paths: DataFrame, hosts: DataFrame) -> float:
    """How many documents a host's mean is worth for its paths, from the spread of the paths'
    means around their own host's beyond what chance explains."""
    p = paths.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("inner"),
    ).first()
    if not p.g:
        return 1e6
    h = hosts.agg(
        F.count("*").alias("g"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("outer"),
        F.sum(F.col("nn") / F.col("n")).alias("share"), F.sum(F.col("s") - F.col("s") * F.col("s") / F.col("n")).alias("odd"),
    ).first()
    within = max(p.q - p.inner, 0.0) / max(p.n - p.g, 1)
    spread = (p.inner - h.outer - (p.g - h.g) * within) / max(p.n - h.share, 1e-9)
    return min(max(h.odd / p.n / spread - 1, 1.0), 1e6) if spread > 1e-9 else 1e6


def _sites(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Documents and sum of verdicts per path and per host, the prior, and both strengths."""
    p = _probability(F.col("_evidence"))
    sums = [F.count("*").cast("double").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")]
    paths = saved(scored.groupBy("_host", "_path").agg(*sums), "paths")
    hosts = saved(
        paths.groupBy("_host").agg(
            *[F.sum(c).alias(c) for c in ("n", "s", "q")], F.sum(F.col("n") * F.col("n")).alias("nn")
        ),
        "hosts",
    )
    prior, host_strength = _strength(hosts)
    path_strength = _nested_strength(paths, hosts)
    totals = hosts.select("_host", F.col("n").alias("_host_n"), F.col("s").alias("_host_s"))
    named = paths.join(totals, "_host").select(
        "_host", "_path", F.col("n").alias("_path_n"), F.col("s").alias("_path_s"), "_host_n", "_host_s")
    return saved(named, "sites"), prior, host_strength, path_strength


def _combined(prior: float, host_strength: float, path_strength: float) -> dict[str, Column]:
    """Posteriors of host and path without the document itself, and its score with them."""
    own = _probability(F.col("_evidence"))
    host = (F.col("_host_s") - own + host_strength * prior) / (F.col("_host_n") - 1 + host_strength)
    low, high = F.lit(1e-6), F.lit(1 - 1e-6)
    host = F.least(F.greatest(host, low), high)
    path = (F.col("_path_s") - own + path_strength * F.col("host_score")) / (F.col("_path_n") - 1 + path_strength)
    return {
        "host_score": host, "path_score": F.least(F.greatest(path, low), high),
        "score": _probability(F.col("_evidence") + _evidence(F.col("path_score")) - _evidence(F.lit(prior))),
    }


def _with_scores(rows: DataFrame, sites: DataFrame, parts: dict[str, Column]) -> DataFrame:
    rows = rows.join(sites, ["_host", "_path"])
    for name, column in parts.items():
        rows = rows.withColumn(f"{name}", column)
    return rows


def score_quality(
    docs: DataFrame, labels: DataFrame, host: str, path: str, label: str = "quality", sample: int = 20_000,
    least: float = 0.5, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Quality of every document from its text and its site.

    A classifier on features of whole texts is fitted on at most ``sample`` labelled
    documents. Its verdicts on all documents are summed per path and host. A host's mean is
    shrunk toward the mean of all documents, a path's toward its host's; how strongly is
    estimated from the spread of the means, of paths around their own host's (empirical
    Bayes, by nested moments). The score adds the
    path's log-odds, taken without the document itself, to those of the text.

    Sums are made before anything is shuffled, so a host may hold any share of the rows; a
    site's sums come back by a join that Spark broadcasts if they are small, and else splits
    where a host is frequent.

    Returns one row per row of ``docs``: its id, ``text_score``, ``host_score``,
    ``path_score``, ``score`` (0 to 1) and ``kept`` (score >= ``least``). A null or empty
    text has the features 0; a null host or path is a site of its own; a null id has no
    label. Labels of one document are averaged, those without a value ignored; without any,
    all documents are good. Extra columns are ignored.
    """
    described = saved(_described(docs, text, doc_id, host, path), "described")
    model = _learned(described, labels, doc_id, label, sample)
    kind = dict(described.dtypes)["_id"]
    scored = described.mapInArrow(_scored(model), f"_id {kind}, _host string, _path string, _evidence double")
    sites, *strengths = _sites(scored)
    return _with_scores(scored, sites, _combined(*strengths)).select(
        F.col("_id").alias(doc_id), _probability(F.col("_evidence")).alias("text_score"), "host_score", "path_score",
        "score", (F.col("score") >= least).alias("kept"),
    )


def keep_quality(
    docs: DataFrame, labels: DataFrame, host: str, path: str, label: str = "quality", sample: int = 20_000,
    least: float = 0.5, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose score by ``score_quality`` is ``least`` or more, columns unchanged.

    The texts are read twice and never shuffled if the sites' sums are small enough to broadcast.
    """
    described = saved(_described(docs, text, doc_id, host, path), "described")
    model = _learned(described, labels, doc_id, label, sample)
    kind = dict(described.dtypes)["_id"]
    scored = described.mapInArrow(_scored(model), f"_id {kind}, _host string, _path string, _evidence double")
    sites, *strengths = _sites(scored)
    placed = docs.select(*site_columns(host, path), F.struct(*docs.columns).alias("_row"))

    def judge(batches):
        for batch in batches:
            names = batch.schema.names
            for part in slices(batch.append_column("_t", batch.column("_row").field(text)), "_t"):
                evidence = model.evidence(text_features(part, "_t"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array(evidence)], [*names, "_evidence"])

    schema = placed.select("*", F.lit(0.0).alias("_evidence")).schema
    judged = _with_scores(placed.mapInArrow(judge, schema), sites, _combined(*strengths))
    return judged.filter(F.col("score") >= least).select("_row.*")
