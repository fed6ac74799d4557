"""The driver tables, and a registry of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Register the function below under its own name."""

        def put(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
