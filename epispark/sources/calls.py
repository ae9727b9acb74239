"""Methylation calls from bedMethyl text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.schemas import BED_METHYL, CALLS


def read_calls(spark: SparkSession, replicates: Mapping[int, str]) -> DataFrame:
    """Calls of all replicates in one table, ``rep`` telling them apart.

    One scan per replicate, joined by a union. A gzip file is one task however large,
    and needs no repartition of its own: the strand merge that follows combines on
    the map side and then shuffles by site.
    """
    whole = None
    for rep, path in replicates.items():
        rows = spark.read.schema(BED_METHYL).option("sep", "\t").option("comment", "#").csv(path)
        rows = rows.select(F.lit(rep).alias("rep"), *CALLS.fieldNames())
        whole = rows if whole is None else whole.unionByName(rows)
    if whole is None:
        raise ValueError("no replicate given")
    return whole
