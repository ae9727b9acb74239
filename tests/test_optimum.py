"""The conditions of the optimum hold for a fitted model and fail for one that is not."""

import numpy as np
from pyspark.sql import functions as F

from epispark.operators import learn
from epispark.sources.staging import written


def test_conditions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)) * [1, 5, 0.1, 1, 1, 2]
    y = (x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=400) > 0.8).astype(int)
    rows = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "features array<double>, label int")
    for l1, l2 in ((0.0, 1e-3), (0.02, 1e-3), (0.05, 0.0)):
        model = learn.fit_weighted_classifier(rows, l1, l2, max_iter=300, tol=1e-12)
        found = learn.optimum_conditions(model, rows, l1, l2).collect()
        assert [r.dim for r in found] == list(range(-1, 6)) and all(r.satisfied for r in found)
        zeros = [r for r in found if r.coefficient == 0]
        assert bool(zeros) == (l1 > 0) and len(zeros) < 6
        assert not all(r.satisfied for r in learn.optimum_conditions(model, rows, l1 + 0.01, l2).collect())
    early = learn.fit_weighted_classifier(rows, 0.0, 1e-3, max_iter=1)
    assert not all(r.satisfied for r in learn.optimum_conditions(early, rows, 0.0, 1e-3).collect())


def test_a_model_scores_after_figures_were_taken(spark, tmp_path):
    rows = spark.createDataFrame([([float(i % 7)], int(i % 7 > 3)) for i in range(50)], "features array<double>, label int")
    kept, figures = written(rows, str(tmp_path / "rows"), n=F.count("*"))
    scores = learn.score(learn.fit_weighted_classifier(kept), kept).collect()
    assert figures == {"n": 50} and all((r.score > 0.5) == r.label for r in scores)
