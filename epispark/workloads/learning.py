"""Queries on predictions, training history and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.operators import learn, metrics as M
from epispark.workloads.bindings import PARAMS, Tables, digest
from epispark.workloads.registry import Registry

_registry = Registry()
query = _registry.add
QUERIES, ORACLES = _registry.queries, _registry.oracles


@query("""
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
               FROM b_predictions),
    l AS (SELECT label, logit AS x FROM b_predictions),
    s AS (SELECT sum(CASE WHEN label = 1 THEN greatest(-x, 0) + ln(1 + exp(-abs(x))) ELSE 0 END) AS ps,
                 sum(CASE WHEN label = 0 THEN greatest(x, 0) + ln(1 + exp(-abs(x))) ELSE 0 END) AS ns FROM l)
    SELECT n AS row_count, round(neg / pos, 6) AS pos_weight, round((neg / pos * ps + ns) / n, 6) AS loss
    FROM c, s""")
def weighted_log_loss(t: Tables):
    found = M.weighted_log_loss(t.predictions)
    return found.select(
        "row_count", F.round("pos_weight", 6).alias("pos_weight"), F.round("loss", 6).alias("loss")
    )


_CONFUSION = """
    SELECT count(*) FILTER (score >= 0.5::DOUBLE AND label = 1) AS tp,
           count(*) FILTER (score >= 0.5::DOUBLE AND label = 0) AS fp,
           count(*) FILTER (score < 0.5::DOUBLE AND label = 1) AS fn,
           count(*) FILTER (score < 0.5::DOUBLE AND label = 0) AS tn FROM b_predictions"""


@query(f"""
    SELECT tp, fp, fn, tn, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
           round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
           round((tp::DOUBLE * tn - fp::DOUBLE * fn)
                 / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) AS mcc
    FROM ({_CONFUSION}) c""")
def confusion_metrics(t: Tables):
    found = M.confusion_metrics(t.predictions, PARAMS.decision_threshold)
    rounded = [F.round(c, 6).alias(c) for c in ("balanced_accuracy", "f1", "mcc")]
    return found.select("tp", "fp", "fn", "tn", *rounded)


@query("""SELECT score, pos, neg, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_neg AS BIGINT) AS cum_neg
          FROM b_cumulative""")
def cumulative_counts(t: Tables):
    return M.cumulative_counts(t.predictions)


@query("""SELECT round(sum(pos * (cum_pos / (cum_pos + cum_neg))) / sum(pos), 6) AS average_precision
          FROM b_cumulative""")
def average_precision(t: Tables):
    found = M.average_precision(M.cumulative_counts(t.predictions))
    return found.select(F.round("average_precision", 6).alias("average_precision"))


@query("""SELECT round(sum(neg * (cum_pos - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc
          FROM b_cumulative""")
def roc_auc(t: Tables):
    found = M.roc_auc(M.cumulative_counts(t.predictions))
    return found.select(F.round("roc_auc", 6).alias("roc_auc"))


@query("""
    WITH th AS (SELECT -1 AS i, 0.5::DOUBLE AS threshold
                UNION ALL SELECT i, 0.05::DOUBLE + i * 0.01::DOUBLE FROM unnest(range(0, 91)) AS u(i)),
    c AS (SELECT i, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp,
                 count(*) FILTER (score >= threshold AND label = 0) AS fp,
                 count(*) FILTER (score < threshold AND label = 1) AS fn,
                 count(*) FILTER (score < threshold AND label = 0) AS tn
          FROM b_predictions, th GROUP BY i, threshold),
    m AS (SELECT i, threshold, CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tn + fp = 0 OR tn + fn = 0 THEN 0 ELSE
            (tp::DOUBLE * tn - fp::DOUBLE * fn)
              / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) END AS mcc FROM c)
    SELECT round(threshold, 6) AS best_threshold, round(mcc, 6) AS best_mcc
    FROM m ORDER BY mcc DESC, i LIMIT 1""")
def threshold_sweep(t: Tables):
    found = M.best_threshold(t.predictions)
    return found.select(
        F.round("best_threshold", 6).alias("best_threshold"), F.round("best_mcc", 6).alias("best_mcc")
    )


@query("""
    WITH w AS (
      SELECT run_id, -1 AS epoch, CAST('inf' AS DOUBLE) AS best, CAST(NULL AS INTEGER) AS best_epoch,
             0 AS waited, CAST(NULL AS INTEGER) AS stop_epoch FROM (SELECT DISTINCT run_id FROM b_history) r
      UNION ALL
      SELECT h.run_id, h.epoch,
             CASE WHEN h.loss < best - 1e-5::DOUBLE THEN h.loss ELSE best END,
             CASE WHEN h.loss < best - 1e-5::DOUBLE THEN h.epoch ELSE best_epoch END,
             CASE WHEN h.loss < best - 1e-5::DOUBLE THEN 0 ELSE waited + 1 END,
             CASE WHEN h.loss >= best - 1e-5::DOUBLE AND phase <> 'frozen' AND waited + 1 >= 5 THEN h.epoch END
      FROM w JOIN b_history h ON h.run_id = w.run_id AND h.epoch = w.epoch + 1 WHERE stop_epoch IS NULL),
    n AS (SELECT run_id, CAST(count(*) AS INTEGER) AS epoch_count FROM b_history GROUP BY run_id)
    SELECT run_id, epoch_count, arg_max(best_epoch, w.epoch) AS best_epoch, arg_max(best, w.epoch) AS best_loss,
           max(stop_epoch) AS stop_epoch
    FROM w JOIN n USING (run_id) GROUP BY run_id, epoch_count""")
def early_stopping_scan(t: Tables):
    return M.early_stopping(t.history, PARAMS.patience, PARAMS.min_delta)


@query()
def weighted_classifier(t: Tables):
    """Scores of the embeddings for one class against the rest; the fit has no SQL form."""
    rows = t.table("embeddings").select(
        "vec_id", F.col("embedding").alias("features"), (F.col("label") < 3).cast("int").alias("label")
    )
    model = learn.fit_weighted_classifier(rows)
    return learn.score(model, rows).select("vec_id", "label", F.round("score", 6).alias("score"))


def _newton(steps: int, penalty: float) -> str:
    """Weighted, penalised logistic regression on two features by Newton's method, step by step."""
    parts = [f"""
    WITH d AS (SELECT vec_id, CAST(label < 3 AS INTEGER) AS y, CAST(embedding[1] AS DOUBLE) AS x1,
                      CAST(embedding[2] AS DOUBLE) AS x2 FROM embeddings),
    c AS (SELECT CAST(count(*) FILTER (y = 0) AS DOUBLE) / count(*) FILTER (y = 1) AS pw FROM d),
    w AS (SELECT d.*, CASE WHEN y = 1 THEN pw ELSE 1 END AS w FROM d, c),
    m AS (SELECT sum(w) AS sw,
                 {penalty!r}::DOUBLE * (sum(w * x1 * x1) - sum(w * x1) ** 2 / sum(w)) / (sum(w) - sum(w * w) / sum(w)) AS v1,
                 {penalty!r}::DOUBLE * (sum(w * x2 * x2) - sum(w * x2) ** 2 / sum(w)) / (sum(w) - sum(w * w) / sum(w)) AS v2
          FROM w),
    s0 AS (SELECT 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2)"""]
    for k in range(1, steps + 1):
        parts.append(f"""
    p{k} AS (SELECT *, p * (1 - p) * w / sw AS q, w * (y - p) / sw AS e FROM (
               SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM w, m, s{k - 1}) z),
    g{k} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(e) AS g0,
               sum(e * x1) - any_value(v1 * b1) AS g1, sum(e * x2) - any_value(v2 * b2) AS g2,
               sum(q) AS a, sum(q * x1) AS b, sum(q * x2) AS c, sum(q * x1 * x1) + any_value(v1) AS d,
               sum(q * x1 * x2) AS e, sum(q * x2 * x2) + any_value(v2) AS f FROM p{k}),
    s{k} AS (SELECT b0 + ((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / t AS b0,
               b1 + ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / t AS b1,
               b2 + ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / t AS b2
             FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS t FROM g{k}) z)""")
    return ",".join(parts) + f"""
    SELECT vec_id, y AS label, round(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 4) AS score FROM d, s{steps}"""


@query(_newton(steps=12, penalty=1e-4))
def weighted_classifier_fit(t: Tables):
    """Scores of a model fitted on two features, where SQL can take the same steps."""
    rows = t.table("embeddings").select(
        "vec_id", F.slice("embedding", 1, 2).alias("features"), (F.col("label") < 3).cast("int").alias("label")
    )
    model = learn.fit_weighted_classifier(rows, max_iter=200, tol=1e-12)
    return learn.score(model, rows).select("vec_id", "label", F.round("score", 4).alias("score"))


def _optimum(t: Tables, l1: float, l2: float):
    """Conditions of the optimum over all features, for one class against the rest."""
    rows = t.table("embeddings").select(
        F.col("embedding").alias("features"), (F.col("label") < 3).cast("int").alias("label")
    )
    model = learn.fit_weighted_classifier(rows, l1=l1, l2=l2, max_iter=500, tol=1e-12)
    return learn.optimum_conditions(model, rows, l1, l2).select("dim", "satisfied")


_OPTIMUM = """SELECT CAST(unnest(range(-1, len(embedding))) AS INTEGER) AS dim, true AS satisfied
              FROM (SELECT embedding FROM embeddings LIMIT 1) e"""


@query(_OPTIMUM)
def classifier_optimum(t: Tables):
    return _optimum(t, l1=0.0, l2=1e-3)


@query(_OPTIMUM)
def sparse_classifier_optimum(t: Tables):
    return _optimum(t, l1=5e-3, l2=1e-3)


@query("""
    WITH k AS (
      SELECT chrom, canonical_position,
             (ascii(substring(sequence, i, 1)) + 5 * ascii(substring(sequence, i + 1, 1))
              + 25 * ascii(substring(sequence, i + 2, 1))) % 64 AS d
      FROM (SELECT *, CAST(unnest(range(1, 50)) AS INTEGER) AS i FROM b_labelled) w),
    c AS (SELECT chrom, canonical_position, d, count(*) / 49.0::DOUBLE AS share FROM k GROUP BY ALL)
    SELECT chrom, canonical_position, CAST(64 AS INTEGER) AS width,
           round(sum(share * (d + 1)), 3) AS weighted_sum, round(sum(share * share), 3) AS square_sum
    FROM c GROUP BY chrom, canonical_position""")
def embed_windows(t: Tables):
    """Every valid window embedded by the stand-in model: shares of its hashed triples."""
    embedded = learn.embed_windows(
        t.valid.select("chrom", "canonical_position", "sequence"),
        "kmer-64-3",
        learn.kmer_model(PARAMS.embedding_width),
        PARAMS.embedding_width,
    )
    return embedded.select("chrom", "canonical_position", *digest("embedding", places=3))
