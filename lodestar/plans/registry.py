"""Where query modules enter their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a data folder by attribute: t.events."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self._dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self._dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Enter a function of Tables as query `name`."""

    def enter(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return enter
