"""Evaluation of scores against binary labels.

Inputs have ``label`` (0 or 1) and ``score``, the loss a ``logit``; anything else in them,
NULL and NaN included, is an error. All counts are integers until the last step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.sources.staging import staged

# The sweep tries 0.5 and then 0.05, 0.06 ... 0.95.
SWEEP = tuple(0.05 + i * 0.01 for i in range(91))
START_THRESHOLD = 0.5

#: Distinct scores that one task sums up in order, at most.
MOST_IN_SLICE = 1 << 18
#: Rows of a table that is sent whole to every task, at most.
MOST_SENT = 1 << 16


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("label") == 0).alias("negative_count"),
        F.count_if(F.col("label") == 1).alias("positive_count"),
    )


def pos_weight(rows: DataFrame) -> DataFrame:
    """Negatives per positive; without positives the query fails."""
    ratio = F.when(
        F.col("positive_count") == 0, F.raise_error(F.lit("no positive labels")).cast("double")
    ).otherwise(F.try_divide(F.col("negative_count"), F.col("positive_count")))
    return class_counts(rows).withColumn("pos_weight", ratio)


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def checked(rows: DataFrame, value: str = "score") -> DataFrame:
    """``rows`` as they are; reading a non-finite value or a label other than 0 and 1 fails."""
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    known = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    wrong = F.raise_error(F.lit(f"a {value} is not finite, or a label neither 0 nor 1"))
    return rows.withColumns({
        value: F.when(finite & known, x).otherwise(wrong.cast("double")),
        "label": F.when(finite & known, F.col("label").cast("int")).otherwise(wrong.cast("int")),
    })


def weighted_log_loss(rows: DataFrame) -> DataFrame:
    """Mean log loss on the logit, positives weighted by negatives per positive.

    The weight is itself a ratio of counts over the same rows, so both halves of the
    loss are summed unweighted in the same pass and weighted at the end. Nothing is cut
    off: a logit of any finite size has its exact loss.
    """
    return _loss(checked(rows, "logit").agg(*_class_sums(), *_loss_sums()))


def _class_sums() -> list[Column]:
    return [F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")]


def _loss_sums() -> list[Column]:
    positive, logit = F.col("label") == 1, F.col("logit")
    return [
        F.sum(F.when(positive, _softplus(-logit)).otherwise(0.0)).alias("pos_loss"),
        F.sum(F.when(~positive, _softplus(logit)).otherwise(0.0)).alias("neg_loss"),
    ]


def loss_of_scores(scores: DataFrame) -> DataFrame:
    """``weighted_log_loss`` from ``score_losses``."""
    return _loss(scores.agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pos_loss", "neg_loss")]))


def _loss(sums: DataFrame) -> DataFrame:
    weight = F.try_divide(F.col("neg"), F.col("pos"))
    return sums.select(
        (F.col("pos") + F.col("neg")).alias("row_count"),
        weight.alias("pos_weight"),
        F.try_divide(weight * F.col("pos_loss") + F.col("neg_loss"), F.col("pos") + F.col("neg")).alias("loss"),
    )


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(margins == 0, 0.0).otherwise(F.try_divide(tp * tn - fp * fn, margins))


def confusion_metrics(rows: DataFrame, threshold: float = START_THRESHOLD) -> DataFrame:
    """Confusion counts with balanced accuracy, F1 and MCC."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    counts = checked(rows).agg(
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
        F.count_if(~hit & ~true).alias("tn"),
    )
    return _confusion(counts)


def confusion_of_scores(scores: DataFrame, threshold: float = START_THRESHOLD) -> DataFrame:
    """``confusion_metrics`` from ``score_counts``."""
    hit = F.col("score") >= threshold

    def total(where: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))

    return _confusion(scores.agg(
        total(hit, "pos").alias("tp"), total(hit, "neg").alias("fp"),
        total(~hit, "pos").alias("fn"), total(~hit, "neg").alias("tn"),
    ))


def _confusion(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recalls = F.array_compact(F.array(F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)))
    total = F.aggregate(recalls, F.lit(0.0), lambda acc, x: acc + x)
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        F.try_divide(total, F.size(recalls)).alias("balanced_accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        mcc(tp, fp, fn, tn).alias("mcc"),
    )


def score_counts(rows: DataFrame) -> DataFrame:
    """Positives and negatives at every distinct score."""
    return checked(rows).groupBy("score").agg(*_class_sums())


def score_losses(rows: DataFrame) -> DataFrame:
    """``score_counts`` with the sums that the log loss is made of: all that an evaluation needs of the rows."""
    return checked(checked(rows, "logit")).groupBy("score").agg(*_class_sums(), *_loss_sums())


def adaptive_slices(scores: DataFrame, most: int = MOST_IN_SLICE) -> DataFrame:
    """Distinct scores with the ``slice`` that each is in: slices rise with the score and hold at
    most ``most`` scores, whatever their distribution.

    The cuts are quantiles of a sketch, twice as many as there must be. Their ranks are off by
    an eighth of ``most`` at most, and scores are distinct, so no slice has over three quarters of it.
    """
    count = scores.count()
    cuts: list[float] = []
    if count > most:
        parts = -(-2 * count // most)
        cuts = sorted(set(scores.approxQuantile("score", [i / parts for i in range(1, parts)], 1 / (4 * parts))))
    if not cuts:
        return scores.withColumn("slice", F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    sliced = Bucketizer(splits=splits, inputCol="score", outputCol="slice").transform(scores)
    return sliced.withColumn("slice", F.col("slice").cast("int"))


def _sent(table: DataFrame, count: int) -> DataFrame:
    return F.broadcast(table) if count <= MOST_SENT else table


def running_counts(scores: DataFrame, most: int = MOST_IN_SLICE) -> DataFrame:
    """Distinct scores (a written table) with the positives and negatives at that score or above.

    A running sum over all scores would be a one-task window: each slice of scores is summed
    on its own, in a stream, and starts from the total of the slices above, which are one
    row each.
    """
    sliced = adaptive_slices(scores, most)
    totals = staged(sliced.groupBy("slice").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")), "slices")
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("slice", *[
        F.coalesce(F.sum(c).over(above), F.lit(0)).alias(name) for c, name in (("_p", "_pos_above"), ("_n", "_neg_above"))
    ])
    inside = (
        Window.partitionBy("slice").orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return sliced.join(_sent(starts, totals.count()), "slice").select(
        "score",
        "pos",
        "neg",
        (F.col("_pos_above") + F.sum("pos").over(inside)).alias("cum_pos"),
        (F.col("_neg_above") + F.sum("neg").over(inside)).alias("cum_neg"),
    )


def cumulative_counts(rows: DataFrame, most: int = MOST_IN_SLICE) -> DataFrame:
    """``running_counts`` of the distinct scores of ``rows``, which are read once."""
    return running_counts(staged(score_counts(rows), "scores"), most)


def ranking_areas(cumulative: DataFrame) -> DataFrame:
    """``average_precision`` and ``roc_auc`` in one pass.

    The first is the precision averaged over the recall steps, 0 without positives; the
    second counts ties half and is NULL with a single class.
    """
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    below = (F.col("cum_pos") - F.col("pos")).cast("double") + F.col("pos") / F.lit(2.0)
    sums = cumulative.agg(
        F.sum(F.col("pos") * precision).alias("steps"),
        F.sum(F.col("neg") * below).alias("pairs"),
        F.sum("pos").cast("double").alias("positives"),
        F.sum("neg").cast("double").alias("negatives"),
    )
    return sums.select(
        F.coalesce(F.try_divide("steps", "positives"), F.lit(0.0)).alias("average_precision"),
        F.try_divide(F.col("pairs"), F.col("positives") * F.col("negatives")).alias("roc_auc"),
    )


def average_precision(cumulative: DataFrame) -> DataFrame:
    return ranking_areas(cumulative).select("average_precision")


def roc_auc(cumulative: DataFrame) -> DataFrame:
    return ranking_areas(cumulative).select("roc_auc")


def threshold_curve(rows: DataFrame) -> DataFrame:
    """MCC at every threshold of the sweep and at 0.5.

    Every row goes to the highest threshold it passes, so one aggregation yields at
    most one row per threshold, and sums over those replace a pass per threshold.
    """
    return curve_of_scores(checked(rows).select(
        "score", (F.col("label") == 1).cast("long").alias("pos"), (F.col("label") == 0).cast("long").alias("neg")
    ))


def curve_of_scores(scores: DataFrame) -> DataFrame:
    """``threshold_curve`` from ``score_counts``."""
    levels = sorted({*SWEEP, START_THRESHOLD})
    splits = [float("-inf"), *levels, float("inf")]
    sliced = Bucketizer(splits=splits, inputCol="score", outputCol="_slice").transform(scores)
    counts = sliced.groupBy(F.col("_slice").cast("int").alias("_slice")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = F.array(*[
        F.struct(F.lit(i).alias("_slice"), F.lit(t).alias("threshold"))
        for i, t in enumerate([None, *levels])
    ])
    every = scores.sparkSession.range(1).select(F.inline(grid))
    filled = every.join(counts, "_slice", "left").na.fill(0, ["pos", "neg"])
    whole = Window.partitionBy(F.lit(1))
    passed = whole.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, fp = F.sum("pos").over(passed), F.sum("neg").over(passed)
    fn, tn = F.sum("pos").over(whole) - tp, F.sum("neg").over(whole) - fp
    curve = filled.select("threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return curve.filter(F.col("threshold").isNotNull()).withColumn(
        "mcc", mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    )


def best_threshold(rows: DataFrame) -> DataFrame:
    """The lowest threshold with the highest MCC, but 0.5 if none is better than 0.5."""
    return best_of_curve(threshold_curve(rows))


def best_of_curve(curve: DataFrame) -> DataFrame:
    preferred = F.when(F.col("threshold") == START_THRESHOLD, 1).otherwise(0)
    order = F.struct("mcc", preferred, -F.col("threshold"))
    return curve.agg(
        F.max_by("threshold", order).alias("best_threshold"), F.max("mcc").alias("best_mcc")
    )


def early_stopping(
    history: DataFrame,
    patience: int,
    min_delta: float,
    value: str = "loss",
    higher_is_better: bool = False,
) -> DataFrame:
    """Best epoch of every run, and the epoch at which it stops for lack of progress.

    The epochs of a run are read in order, as a stream: a task holds one batch and the
    state of one run, so a run may have any number of epochs. Patience keeps counting while
    the phase is ``frozen`` but does not stop the run then. A value that is NULL or NaN is no
    progress; a missing or repeated epoch number is an error. ``stop_epoch`` is NULL for a
    run that goes on to its end.
    """
    best_name, sign = f"best_{value}", -1.0 if higher_is_better else 1.0
    run_type = dict(history.dtypes)["run_id"]
    names = ["run_id", "epoch_count", "best_epoch", best_name, "stop_epoch"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, run, fresh = [], None, {"n": 0, "best": float("inf"), "at": None, "waited": 0, "stop": None, "last": None}
        state = dict(fresh)

        def close():
            if state["n"]:
                best = None if state["at"] is None else sign * state["best"]
                done.append((run, state["n"], state["at"], best, state["stop"]))

        def flushed(kind):
            columns = list(zip(*done)) if done else [[]] * 5
            done.clear()
            types = (kind, pa.int32(), pa.int32(), pa.float64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("run_id").type
            for key, epoch, phase, x in zip(*(batch.column(c).to_pylist() for c in ("run_id", "epoch", "phase", "_value"))):
                if key != run or not state["n"]:
                    close()
                    run, state = key, dict(fresh)
                if epoch is None or epoch == state["last"]:
                    raise ValueError(f"run {run}: epoch {epoch} is missing or repeated")
                state["last"], state["n"] = epoch, state["n"] + 1
                if state["stop"] is None:
                    if x is not None and sign * x < state["best"] - min_delta:
                        state.update(best=sign * x, at=epoch, waited=0)
                    else:
                        state["waited"] += 1
                        if phase != "frozen" and state["waited"] >= patience:
                            state["stop"] = epoch
            yield flushed(kind)
        if kind is not None:
            close()
            yield flushed(kind)

    runs = history.select("run_id", F.col("epoch").cast("int").alias("epoch"), "phase", F.col(value).cast("double").alias("_value"))
    return runs.repartition("run_id").sortWithinPartitions("run_id", "epoch").mapInArrow(
        scan, f"run_id {run_type}, epoch_count int, best_epoch int, {best_name} double, stop_epoch int"
    )
