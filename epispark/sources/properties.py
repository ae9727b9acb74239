"""The table of twelve properties per dinucleotide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.sequence import clean
from epispark.functions.vectors import all_finite
from epispark.operators.audit import require_empty
from epispark.params import BASE_ORDER, PROPERTY_COUNT

DINUCLEOTIDES = tuple(a + b for a in BASE_ORDER for b in BASE_ORDER)


def _problem(count: int) -> Column:
    values = F.col("properties")
    return (
        F.when(F.coalesce(~F.col("dinucleotide").isin(*DINUCLEOTIDES), F.lit(True)), "invalid dinucleotide")
        .when(values.isNull() | (F.size(values) != count), "wrong number of properties")
        .when(~all_finite(values), "non-finite value")
    )


def check_properties(raw: DataFrame, count: int = PROPERTY_COUNT) -> DataFrame:
    """``row_number, dinucleotide, properties`` with the name cleaned and the first problem found."""
    return raw.withColumn("dinucleotide", clean(F.col("dinucleotide"))).withColumn("problem", _problem(count))


def last_per_dinucleotide(checked: DataFrame) -> DataFrame:
    """One row per valid dinucleotide: the last one given wins."""
    return (
        checked.filter(F.col("problem").isNull())
        .groupBy("dinucleotide")
        .agg(F.max_by("properties", "row_number").alias("properties"))
    )


def as_literal(table: DataFrame) -> list[list[float]]:
    """A table of valid dinucleotides in code order AA, AC ... TT; 16 rows are collected."""
    rows = {r["dinucleotide"]: list(r["properties"]) for r in table.collect()}
    missing = [d for d in DINUCLEOTIDES if d not in rows]
    if missing:
        raise ValueError(f"missing dinucleotides: {', '.join(missing)}")
    return [[float(v) for v in rows[d]] for d in DINUCLEOTIDES]


def load_properties(raw: DataFrame, count: int = PROPERTY_COUNT) -> list[list[float]]:
    """The checked table as a literal; any bad or missing row is an error."""
    checked = check_properties(raw, count)
    require_empty(checked.filter(F.col("problem").isNotNull()), "bad property rows")
    return as_literal(last_per_dinucleotide(checked))


def read_property_csv(spark, path: str, count: int = PROPERTY_COUNT) -> DataFrame:
    """A headed CSV of a dinucleotide and its properties, with the line order as row number."""
    names = ["dinucleotide", *[f"p{i}" for i in range(count)]]
    schema = ", ".join([f"{names[0]} string", *[f"{n} float" for n in names[1:]]])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(
        F.monotonically_increasing_id().alias("row_number"),
        "dinucleotide",
        F.array(*names[1:]).alias("properties"),
    )
