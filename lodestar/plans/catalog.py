"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators import drift, timestamps
from lodestar.plans import evidence, findings, records, scans, stacks, streams  # noqa: F401  each enters its queries
from lodestar.plans.registry import QUERIES, SQL, Tables, query

Query = Callable[[SparkSession, str], DataFrame]


@query("p4_found")
def _(t: Tables) -> DataFrame:
    return timestamps.times_found(t.component_rows, t.autoruns_known_good, t.clients)


@query("p5_found")
def _(t: Tables) -> DataFrame:
    return drift.drift_found(t.component_files, t.schema_contract)


@query("p5_table")
def _(t: Tables) -> DataFrame:
    return drift.ingest(t.component_files, t.schema_contract)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
