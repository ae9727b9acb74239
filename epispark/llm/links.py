"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.store import saved


def whole_numbers(rows: DataFrame, column: str) -> None:
    """Raise a TypeError unless ``column`` holds whole numbers (or nothing but nulls)."""
    kind = rows.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{column} must be whole numbers, not {kind.simpleString()}")


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with what ``least`` says of their ``u``. The join has a key of its own, so Spark
    deals out both sides for it and can split those of a node with very many edges."""
    key = F.struct("u").alias("_key")
    return edges.select("u", "v", key).join(least.select("m", key), "_key")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component``: for every node of an edge the smallest node reachable from it.

    Alternates two steps until nothing changes: every node points its larger neighbours at
    its smallest neighbour, then its smaller neighbours at that one. A star of any size
    costs one sum per task and key, and the number of rounds grows with the logarithm of
    the longest path. Loops and repeated edges don't matter; edges with a null are none.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = saved(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), (u + v).alias("s"))
        .filter("s is not null and u <> v").select("u", "v").distinct(),
        "edges",
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            _met(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _met(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        now = saved(small, "edges")
        figures = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if figures == seen:
            break
        seen = figures
    rays = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rays.unionByName(rays.select(F.col("component").alias("node"), "component").distinct())
