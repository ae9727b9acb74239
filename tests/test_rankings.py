"""Ranking metrics on scores of any distribution, and evaluation in one pass."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.operators import metrics as M
from epispark.params import WGBS_GRCH38
from epispark.plans.features import evaluate

RNG = np.random.default_rng(3)
SCORES = {
    "within 1e-9": 0.5 + RNG.random(3000) * 1e-9,
    "outside 0 to 1": np.concatenate([RNG.normal(50, 1, 1500), RNG.normal(-3e6, 2, 1500)]),
    "near 0": 10.0 ** -(RNG.random(3000) * 300),
    "all magnitudes": np.concatenate([RNG.choice([-1, 1], 1500) * 2.0 ** RNG.integers(-1000, 1000, 1500), [1.7e308, -1.7e308, 5e-324, 0.0]]),
    "few": RNG.integers(0, 4, 3000) / 4,
}


@pytest.mark.parametrize("name", SCORES)
def test_no_slice_is_too_full_and_the_counts_are_right(spark, name):
    scores = SCORES[name]
    labels = RNG.integers(0, 2, len(scores))
    rows = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "score double, label int").repartition(5)
    most = 100
    sliced = M.adaptive_slices(M.staged(M.score_counts(rows), "test"), most)
    slices = sliced.groupBy("slice").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    assert max(r["n"] for r in slices) <= most
    slices.sort(key=lambda r: r["slice"])
    assert all(a["high"] < b["low"] for a, b in zip(slices, slices[1:]))
    found = {r["score"]: (r["cum_pos"], r["cum_neg"]) for r in M.cumulative_counts(rows, most).collect()}
    order = np.argsort(-scores, kind="stable")
    pos, neg = np.cumsum(labels[order]), np.cumsum(1 - labels[order])
    assert found == {float(s): (int(p), int(n)) for s, p, n in zip(scores[order], pos, neg)}


def test_evaluation_reads_its_input_once(spark):
    n = 400
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    made = spark.range(n).select(
        ((F.col("id") * 7) % 10 < 4).cast("int").alias("label"), ((F.col("id") * 37) % 100 / 100).alias("score"),
        (((F.col("id") * 37) % 100 - 50) / 10).alias("logit"),
    )
    predictions = made.mapInArrow(counted, made.schema)
    figures = {r["metric"]: r["value"] for r in evaluate(predictions, replace(WGBS_GRCH38, decision_threshold=0.3)).collect()}
    assert read.value == n
    for one in (M.weighted_log_loss(made), M.confusion_metrics(made, 0.3), M.ranking_areas(M.cumulative_counts(made)), M.best_threshold(made)):
        for metric, value in one.first().asDict().items():
            assert figures[metric] == pytest.approx(value), metric


def test_empty_predictions(spark):
    none = spark.createDataFrame([], "label int, score double, logit double")
    figures = {r["metric"]: r["value"] for r in evaluate(none, WGBS_GRCH38).collect()}
    assert figures["row_count"] is None or figures["row_count"] == 0
    assert figures["average_precision"] == 0 and figures["roc_auc"] is None and figures["tp"] == 0
