"""Findings: ranking, consolidation, timelines and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """The place of a value in a list, from 1; values not in it come after all."""
    at = F.array_position(F.array(*map(F.lit, order)), F.coalesce(c, F.lit("")))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def natural_key(c: Column) -> Column:
    """Text that sorts by its numbers as numbers: each has its length before it, the rest is in lower case."""
    parts = F.regexp_extract_all(F.lower(c.cast("string")), F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), _sized(p)).otherwise(p)), "")


def _sized(digits: Column) -> Column:
    n = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(n).cast("string"), 10, "0"), n)


def consolidate(df: DataFrame, keys: Sequence[str], priority: str, order: Sequence[str], evidence: str) -> DataFrame:
    """keys, best priority, number of findings and of distinct evidence."""
    best = F.min(F.struct(rank_of(F.col(priority), order).alias("r"), F.col(priority).alias("p")))
    return df.groupBy(*keys).agg(best["p"].alias(priority), F.count("*").alias("findings"), F.count_distinct(evidence).alias("evidence"))


def merge_without_conflict(df: DataFrame, keys: Sequence[str], scope: str, count: Column, representative: Column) -> DataFrame:
    """Keys that have exactly one scope, with their summed count and least representative."""
    g = df.groupBy(*keys).agg(F.min(scope).alias(scope), F.max(scope).alias("_z"), F.sum(count).alias("occurrences"), F.min(representative).alias("representative"))
    return g.where(F.col(scope) == F.col("_z")).drop("_z")


def timeline(df: DataFrame, time: Column, rank: Column, tie: Sequence[str], most: int) -> DataFrame:
    """The `most` distinct events of best rank (then earliest), to be read in time order."""
    return df.withColumns({"_t": time, "_rank": rank}).where("_t is not null").orderBy("_rank", "_t", *tie).limit(most).orderBy("_t", *tie).drop("_rank")


def page(df: DataFrame, order: Sequence[str | Column], offset: int, size: int) -> DataFrame:
    """Rows offset+1 … offset+size in the order."""
    return df.orderBy(*order).offset(offset).limit(size)


def probe(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first `most` rows and whether there were more: one row more is read, not all counted."""
    from pyspark.sql.window import Window

    head = df.orderBy(*order).limit(most + 1)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # over most + 1 rows
    r = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return head.withColumns({"truncated": n > most, "_r": r}).where(F.col("_r") <= most).drop("_r")
