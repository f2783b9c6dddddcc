"""How a family module registers a query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Family:
    """Queries of one family; a query without SQL is checked by tests alone."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
