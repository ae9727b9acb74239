"""Models applied to, or fitted on, tables of vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.sources.staging import staging_folder

Model = Callable[[list], np.ndarray]

_loaded: dict[str, Model] = {}


def _apply_model(
    rows: DataFrame, column: str, field: T.StructField, name: str, load: Callable[[], Model], shape: tuple
) -> DataFrame:
    """Add ``field``, computed batch by batch by a user's model from ``column``.

    ``load`` builds the model; it runs once per Python worker, which keeps the model
    under ``name``.
    """
    schema = T.StructType([*rows.schema.fields, field])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from epispark.operators.learn import _loaded as kept
        except ImportError:
            kept = {}  # the package was not shipped to the workers: load once per task
        if name not in kept:
            kept[name] = load()
        model = kept[name]
        for batch in batches:
            if not len(batch):
                continue
            result = np.asarray(model(batch[column].tolist()))
            if result.shape != (len(batch), *shape):
                raise ValueError(f"the model returned shape {result.shape}")
            if not np.isfinite(result).all():
                raise ValueError("the model returned a non-finite value")
            yield batch.assign(**{field.name: list(result)})

    return rows.mapInPandas(run, schema)


def embed_windows(windows: DataFrame, name: str, load: Callable[[], Model], width: int) -> DataFrame:
    """Add ``embedding``, computed from ``sequence``. Filter before: each row costs a model call."""
    field = T.StructField("embedding", T.ArrayType(T.FloatType()))
    return _apply_model(windows, "sequence", field, name, load, (width,))


def score_rows(rows: DataFrame, name: str, load: Callable[[], Model]) -> DataFrame:
    """Add ``score``, the probability a user's model gives to ``features``."""
    return _apply_model(rows, "features", T.StructField("score", T.DoubleType()), name, load, ())


def kmer_model(width: int = 64, k: int = 3) -> Callable[[], Model]:
    """A small deterministic stand-in: shares of the hashed k-mers of a window."""

    def load() -> Model:
        def embed(sequences: list[str]) -> np.ndarray:
            if len({len(s) for s in sequences}) > 1:
                raise ValueError("the windows differ in length")
            joined = np.frombuffer("".join(sequences).encode("ascii"), dtype=np.uint8)
            letters = joined.astype(np.int64).reshape(len(sequences), -1)
            kmers = np.lib.stride_tricks.sliding_window_view(letters, k, axis=1) @ 5 ** np.arange(k)
            rows = np.arange(len(sequences))[:, None] * width
            counts = np.bincount((kmers % width + rows).ravel(), minlength=len(sequences) * width)
            return counts.reshape(len(sequences), width) / kmers.shape[1]

        return embed

    return load


def fit_weighted_classifier(
    rows: DataFrame, l1: float = 0.0, l2: float = 1e-4, max_iter: int = 50, tol: float = 1e-6
) -> LogisticRegressionModel:
    """Logistic regression on ``features``, positives weighted by negatives per positive.

    ``features`` is an array column. ``l1`` and ``l2`` are the two penalties. The model comes
    back from the staging folder: as fitted it has a summary that holds the session, which
    cannot be sent to tasks once figures were taken in it (``sources.staging.written``).
    """
    counts = rows.agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    ).first()
    if not counts["pos"]:
        raise ValueError("no positive labels")
    weight = F.when(F.col("label") == 1, counts["neg"] / counts["pos"]).otherwise(1.0)
    data = rows.select(
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("features").cast("array<double>")).alias("features"),
        weight.alias("weight"),
    )
    total = l1 + l2
    fitted = LogisticRegression(
        weightCol="weight",
        regParam=total,
        elasticNetParam=l1 / total if total else 0.0,
        maxIter=max_iter,
        tol=tol,
    )
    path = f"{staging_folder(rows.sparkSession)}/model-{uuid.uuid4().hex}"
    fitted.fit(data).write().save(path)
    return LogisticRegressionModel.load(path)


def score(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Add ``score``, the probability of the positive class."""
    data = rows.withColumn("_features", array_to_vector(F.col("features").cast("array<double>")))
    named = model.copy().setFeaturesCol("_features").setPredictionCol("").setRawPredictionCol("")
    scored = named.transform(data)
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "_features", "probability"
    )


def optimum_conditions(
    model: LogisticRegressionModel, rows: DataFrame, l1: float = 0.0, l2: float = 1e-4, tolerance: float = 1e-5
) -> DataFrame:
    """Whether the model is at the optimum of ``fit_weighted_classifier``: ``dim``, ``coefficient``, ``slope``, ``satisfied``.

    ``dim`` is -1 for the intercept. The penalties are on coefficients of features scaled to
    unit deviation. A slope, the loss's with the L2 part, must be 0 for the intercept and with
    L2 alone; with an L1 part it must be ``l1`` times the deviation against the sign of a
    coefficient, and no steeper than that where the coefficient is 0. One pass sums vectors.
    """
    counts = rows.agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    ).first()
    weight = F.when(F.col("label") == 1, counts["neg"] / counts["pos"]).otherwise(1.0)
    scored = score(model, rows).select(
        F.col("features").cast("array<double>").alias("x"), weight.alias("w"),
        (weight * (F.col("score") - F.col("label").cast("double"))).alias("r"),
    )
    vector = array_to_vector("x")
    scaled = array_to_vector(F.transform("x", lambda v: v * F.col("r")))
    sums = scored.agg(
        F.sum("w").alias("total"), F.sum("r").alias("residual"), vector_to_array(Summarizer.sum(scaled)).alias("g"),
        vector_to_array(Summarizer.variance(vector, F.col("w"))).alias("v"),
    ).first()
    total, spread = sums["total"], np.sqrt(np.array(sums["v"]))
    beta = model.coefficients.toArray()
    slope = np.array(sums["g"]) / total + l2 * spread**2 * beta
    bound = l1 * spread
    met = np.where(beta != 0, np.abs(slope + bound * np.sign(beta)) <= tolerance, np.abs(slope) <= bound + tolerance)
    intercept = float(sums["residual"] / total)
    found = [(-1, float(model.intercept), intercept, bool(abs(intercept) <= tolerance))]
    found += [(j, float(b), float(s), bool(m)) for j, (b, s, m) in enumerate(zip(beta, slope, met))]
    return rows.sparkSession.createDataFrame(found, "dim int, coefficient double, slope double, satisfied boolean")
