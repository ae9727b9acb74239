"""Results in versions: readers see the last one that passed its checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.sources.tables import read_or_empty

Made = TypeVar("Made")

#: The published versions in order; the last one counts.
POINTER = T.StructType([T.StructField("number", T.LongType()), T.StructField("version", T.StringType())])


def _last(spark: SparkSession, path: str):
    table = read_or_empty(spark, f"{path}/published", POINTER)
    return table.orderBy(F.desc("number"), F.desc("version")).first()


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that readers of ``path`` are to use."""
    last = _last(spark, path)
    if last is None:
        raise FileNotFoundError(f"nothing has been published in {path}")
    return f"{path}/versions/{last['version']}"


def publish(spark: SparkSession, path: str, build: Callable[[str], Made]) -> Made:
    """Let ``build`` write and check a version in a folder of its own, then make it the current one.

    If it raises, the pointer stays where it is and the version before remains readable. The
    switch is the commit of one small file. Older versions stay until someone removes them.
    """
    last = _last(spark, path)
    number = 1 + (last["number"] if last else 0)
    version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    made = build(f"{path}/versions/{version}")
    spark.createDataFrame([(number, version)], POINTER).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return made
