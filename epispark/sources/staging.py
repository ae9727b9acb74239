"""Tables written on the way, for steps that read their input more than once or in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def staging_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share.

    A session on one machine without it gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="epispark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the staging folder and read back. The files stay until it is cleared."""
    path = f"{staging_folder(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), **figures: Column) -> tuple[DataFrame, dict]:
    """Write ``df``, and return it read back with ``figures`` (aggregates) taken over the rows as they were written.

    Nothing is read again for them. They are exact though tasks may run more than once: the
    write is the last stage, where Spark counts each partition once. ``df`` must therefore not
    be moved behind this. A figure of a table that turns out to be empty may be missing: None.
    """
    seen = Observation()
    df.observe(seen, *[column.alias(name) for name, column in figures.items()]).write.mode("overwrite").partitionBy(
        *partition_by
    ).parquet(path)
    found = seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path), {name: found.get(name) for name in figures}
