"""Contact records from text or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epispark.schemas import CONTACTS


def read_contacts(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """``chrom, pos_x, pos_y, count`` of one normalisation, both ends on one chromosome."""
    reader = spark.read.schema(CONTACTS)
    if format == "csv":
        return reader.option("sep", "\t").option("nanValue", "NaN").csv(path)
    return reader.format(format).load(path)
