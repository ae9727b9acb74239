"""Balancing of contact counts: a bias for every bin, so that all bins have the same sum of contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.functions.vectors import is_finite
from epispark.sources.staging import staged

#: Bins whose biases are sent whole to every task; beyond it both sides are shuffled.
MOST_SENT = 1 << 20


def contact_matrix(contacts: DataFrame, min_partners: int = 1) -> DataFrame:
    """Both directions of the summed positive contacts: ``chrom, bin, other, weight``.

    Bins with contacts to fewer than ``min_partners`` bins (themselves included) are left out,
    with all their contacts; others may have fewer partners afterwards.
    """
    x, y = F.least("bin_x", "bin_y"), F.greatest("bin_x", "bin_y")
    pairs = (
        contacts.filter(is_finite(F.col("count")) & (F.col("count") > 0))
        .groupBy("chrom", x.alias("lo"), y.alias("hi")).agg(F.sum(F.col("count").cast("double")).alias("weight"))
    )
    there = F.struct(F.col("lo").alias("bin"), F.col("hi").alias("other"))
    back = F.struct(F.col("hi").alias("bin"), F.col("lo").alias("other"))
    both = F.when(F.col("lo") == F.col("hi"), F.array(there)).otherwise(F.array(there, back))
    matrix = pairs.select("chrom", F.explode(both).alias("at"), "weight").select("chrom", "at.*", "weight")
    if min_partners > 1:
        matrix = staged(matrix, "contacts")
        sparse = matrix.groupBy("chrom", "bin").agg(F.count("*").alias("n")).filter(F.col("n") < min_partners).drop("n")
        matrix = matrix.join(sparse, ["chrom", "bin"], "left_anti").join(
            sparse.withColumnRenamed("bin", "other"), ["chrom", "other"], "left_anti"
        ).select("chrom", "bin", "other", "weight")
    return matrix


def bin_biases(
    matrix: DataFrame, steps: int = 100, tolerance: float = 1e-3, most_sent: int = MOST_SENT
) -> DataFrame:
    """``chrom, bin, bias, row_sum``: with ``bias`` of both its bins multiplied to every contact, the
    contacts of each bin add up to ``row_sum``, which is 1 within the tolerance.

    A fixpoint in rounds: every bias is divided by the square root of its bin's sum. A
    chromosome whose bins all are within the tolerance is left as it is; the rounds end when
    none is left or after ``steps``. Bins that are not within the tolerance then get NaN.
    A round sums the matrix once, combined before the shuffle, and writes one row per bin.
    """
    matrix = staged(matrix, "matrix")
    bins = matrix.select("chrom", "bin").distinct().withColumn("bias", F.lit(1.0))
    few = None
    for step in range(steps + 1):
        sent = bins.select("chrom", F.col("bin").alias("other"), F.col("bias").alias("other_bias"))
        sums = (
            matrix.join(F.broadcast(sent) if few else sent, ["chrom", "other"])
            .groupBy("chrom", "bin").agg(F.sum(F.col("weight") * F.col("other_bias")).alias("sum"))
        )
        now = staged(
            bins.join(sums, ["chrom", "bin"]).select("chrom", "bin", "bias", (F.col("bias") * F.col("sum")).alias("row_sum")),
            f"biases-{step}",
        )
        few = now.count() <= most_sent if few is None else few
        worst = now.groupBy("chrom").agg(F.max(F.abs(F.col("row_sum") - 1)).alias("worst"))
        if step == steps or worst.filter(F.col("worst") > tolerance).isEmpty():
            break
        stepped = F.when(F.col("worst") > tolerance, F.col("bias") / F.sqrt("row_sum")).otherwise(F.col("bias"))
        bins = now.join(worst, "chrom").select("chrom", "bin", stepped.alias("bias"))
    settled = F.abs(F.col("row_sum") - 1) <= tolerance
    return now.withColumn("bias", F.when(settled, F.col("bias")).otherwise(float("nan")))


def balance_contacts(
    contacts: DataFrame,
    steps: int = 100,
    tolerance: float = 1e-3,
    min_partners: int = 1,
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """``contacts`` with ``count`` balanced, scaled so that a chromosome keeps the total of its balanced records.

    ``count`` is NaN where a bin of the record did not converge, has too few partners or no
    contact at all, and where it was not finite before; ``finite_contacts`` drops those.
    """
    biases = bin_biases(contact_matrix(contacts, min_partners), steps, tolerance, most_sent)
    few = biases.count() <= most_sent
    placed = contacts.withColumn("_count", F.when(is_finite(F.col("count")), F.col("count").cast("double")))
    for end in ("x", "y"):
        side = biases.select("chrom", F.col("bin").alias(f"bin_{end}"), F.nanvl("bias", F.lit(None)).alias(f"_bias_{end}"))
        placed = placed.join(F.broadcast(side) if few else side, ["chrom", f"bin_{end}"], "left")
    balanced = F.col("_count") * F.col("_bias_x") * F.col("_bias_y")
    scales = placed.groupBy("chrom").agg(
        F.try_divide(F.sum(F.when(balanced.isNotNull(), F.col("_count"))), F.sum(balanced)).alias("_scale")
    )
    whole = placed.join(scales, "chrom", "left")
    return whole.withColumn("count", F.coalesce(balanced * F.col("_scale"), F.lit(float("nan")))).select(*contacts.columns)
