"""Fleet views: who answered, what was covered, what a log used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_class(state: Column, classes: dict[str, Sequence[str]], other: str = "unknown") -> Column:
    """The class whose states hold the value, whatever its case; `other` for the rest and null."""
    out = None
    for name, states in classes.items():
        hit = F.upper(F.trim(state)).isin(*[s.upper() for s in states])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def response_summary(base: DataFrame, flows: DataFrame, client: str, state: str) -> DataFrame:
    """One row: baseline clients, and of them responded, with open, with failed and with only finished flows, pending.

    Flows come down to one row per client before they meet the baseline.
    """
    per = flows.groupBy(client).agg(F.max(F.col(state) == "open").alias("o"), F.max(F.col(state) == "failed").alias("f"))
    j = base.select(client).distinct().join(per, client, "left")
    return j.agg(
        F.count("*").alias("baseline"),
        F.count("o").alias("responded"),
        F.count_if("o").alias("with_open"),
        F.count_if("f").alias("with_failed"),
        F.count_if(~F.col("o") & ~F.col("f")).alias("finished"),
        F.count_if(F.col("o").isNull()).alias("pending"),
    )


def coverage(wanted: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key, n, status for every wanted key: observed, empty (seen without rows) or not_observed. seen has key and n."""
    s = seen.groupBy(key).agg(F.sum("n").alias("n"))
    status = F.when(F.col("n") > 0, "observed").when(F.col("n") == 0, "empty").otherwise("not_observed")
    return wanted.select(key).distinct().join(s, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def scope_coverage(artifacts: DataFrame, key: str, has_time: Column) -> DataFrame:
    """One row: artifacts, those with a time to filter by, and whether a time scope covers all, some or none of them."""
    a = artifacts.groupBy(key).agg(F.max(has_time).alias("t"))
    status = F.when(F.count("*") == 0, "not_requested").when(F.count_if("t") == F.count("*"), "complete").when(F.count_if("t") > 0, "partial").otherwise("unsupported")
    return a.agg(F.count("*").alias("artifacts"), F.count_if("t").alias("supported"), status.alias("status"))


def log_fields(text: Column, keys: Sequence[str]) -> list[Column]:
    """The values of `key=value` pairs of a log line; a value may be quoted."""
    return [F.nullif(F.regexp_replace(F.regexp_extract(text, rf'(?:^|[\s|])(?:{k})=("[^"]*"|\S*)', 1), '^"|"$', ""), F.lit("")).alias(k) for k in keys]


def usage_rollup(df: DataFrame, once: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """Per `by`: requests (rows once per `once`), total and retried: rows beyond the first of their invocation."""
    d = df.groupBy(*once).agg(*[F.min(b).alias(b) for b in by if b not in once], F.max(value).alias(value))
    return d.groupBy(*by).agg(F.count("*").alias("requests"), F.sum(value).alias("total"))


def retry_candidates(base: DataFrame, seen: DataFrame, attempts: DataFrame, key: str, most: int) -> DataFrame:
    """Keys of the baseline that haven't been seen and were tried less than `most` times."""
    open_ = base.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")
    return open_.join(attempts.groupBy(key).agg(F.count("*").alias("attempts")), key, "left").select(key, F.coalesce("attempts", F.lit(0)).alias("attempts")).where(F.col("attempts") < most)


def readiness(completed: Column, terminal: Column, failed: Column, baseline: Column, hours: Column) -> Column:
    """ready, stalled or not_ready; baseline_empty without a baseline.

    Ready: all terminal, 0.8 completed, or 0.7 after 24 hours. Stalled: after 24 hours less than 0.2 completed or 0.5 failed.
    """
    done, bad, late = completed / baseline, failed / baseline, F.coalesce(hours >= 24, F.lit(False))
    return (
        F.when(baseline <= 0, "baseline_empty")
        .when((terminal >= baseline) | (done >= 0.8) | (late & (done >= 0.7)), "ready")
        .when(late & ((done < 0.2) | (bad >= 0.5)), "stalled")
        .otherwise("not_ready")
    )


def coverage_ladder(reviewed: Column, target: Column, terminal: Column) -> Column:
    """complete, provisional, unknown or incomplete, from whether all is reviewed, the coverage of the targets and the source's state."""
    return F.when(reviewed & (target == "complete") & terminal, "complete").when(~terminal | (target == "provisional"), "provisional").when(target == "unknown", "unknown").otherwise("incomplete")


def accounted(scope: Column, remaining: Column) -> Column:
    """What is accounted for of a scope; never less than none."""
    return F.greatest(F.lit(0), scope - remaining)
