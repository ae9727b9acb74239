"""How a module lists its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epispark.workloads.bindings import Tables, with_views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and SQL counterparts under common names."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register the decorated ``Tables -> DataFrame`` under its name."""

        def register(build: Callable[[Tables], DataFrame]):
            name = build.__name__
            self.queries[name] = lambda spark, folder: build(Tables(spark, folder))
            if sql is not None:
                self.oracles[name] = with_views(sql.strip())
            return build

        return register
