"""Known-good rules: subtraction by exact identity and by pattern, merging, comparing and updating rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import identity_key

#: Constructs that the pattern dialects don't share.
UNSHARED = r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\C|[*+?}]\+"


def usable_rule(pattern: Column) -> Column:
    """Whether a pattern keeps to what all dialects in use share: no look-around, back references, \\C, possessive repeats."""
    return pattern.isNotNull() & ~pattern.rlike(UNSHARED)


def subtract_exact(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys no known row has. Distinct keys are joined; the planner broadcasts them if they are small."""
    return rows.join(known.select(*keys).distinct(), list(keys), "left_anti")


def subtract_patterns(identities: DataFrame, rules: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Identities that no rule matches in all its fields; give distinct identities, each is tested once against the rules."""
    from lodestar.operators.stacks import unmatched

    return unmatched(identities, rules, pairs)


def subtract_identities(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose identity, the hash of their normalised image path, launch string and signer, no known row has.

    User folders, system variables, letter case and missing values don't matter; only the hashes cross the shuffle of the known side.
    """
    have = known.select(identity_key(*[F.col(k) for k in keys]).alias("_identity")).distinct()
    return rows.withColumn("_identity", identity_key(*[F.col(k) for k in keys])).join(have, "_identity", "left_anti").drop("_identity")


def select_identities(rows: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose identity one of the chosen rows has."""
    want = chosen.select(identity_key(*[F.col(k) for k in keys]).alias("_identity")).distinct()
    return rows.withColumn("_identity", identity_key(*[F.col(k) for k in keys])).join(want, "_identity", "left_semi").drop("_identity")


def delete_by_key(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the rows whose keys are in `gone`; null keys match null keys."""
    g = gone.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).distinct()
    on = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_g{i}"))
        on = c if on is None else on & c
    return table.join(g, on, "left_anti")


def known_good_filter(rows: DataFrame, keys: Sequence[str], exact: DataFrame, rules: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Rows left by both subtractions, by identity and by pattern. keys are image path, launch string and signer.

    Rows with all keys blank are left out; patterns are tested per distinct combination of keys.
    """
    from lodestar.functions.text import blank

    some = None
    for k in keys:
        some = ~blank(F.col(k)) if some is None else some | ~blank(F.col(k))
    filled = subtract_identities(rows.where(some), exact, keys)
    left = subtract_patterns(filled.select(*keys).distinct(), rules, pairs)
    right = left.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = None
    for k in keys:
        c = filled[k].eqNullSafe(right[f"_k_{k}"])
        on = c if on is None else on & c
    return filled.join(right, on, "left_semi")


def reconcile(rows: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value) of rows with status: new_identity, already_applied or description_update."""
    b = base.groupBy(key).agg(F.min(value).alias("_base"), F.count("*").alias("_n"))
    r = rows.groupBy(key).agg(F.min(value).alias(value))
    status = F.when(F.col("_n").isNull(), "new_identity").when(F.col(value).eqNullSafe(F.col("_base")), "already_applied").otherwise("description_update")
    return r.join(b, key, "left").select(key, value, status.alias("status"))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and change: added, removed, updated or unchanged. Null keys are keys."""
    o = old.groupBy(*keys).agg(F.min(value).alias("_o")).withColumn("_in_o", F.lit(True))
    n = new.groupBy(*keys).agg(F.min(value).alias("_n")).withColumn("_in_n", F.lit(True))
    both = o.withColumns({f"_k{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(keys)}).drop(*keys)
    there = n.withColumns({f"_k{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(keys)}).drop(*keys)
    j = both.join(there, [f"_k{i}" for i in range(len(keys))], "full_outer")
    change = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")
    return j.select(*[F.when(F.col(f"_k{i}") != "", F.substring(F.col(f"_k{i}"), 2, 1 << 30)).alias(k) for i, k in enumerate(keys)], change.alias("change"))


def merge(tables: Sequence[DataFrame], keys: Sequence[str], payload: str, strict: bool = False) -> DataFrame:
    """One row per key with its payload and how many different payloads it had; strict fails on more than one."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t)
    out = u.groupBy(*keys).agg(F.min(payload).alias(payload), F.count_distinct(F.coalesce(F.col(payload), F.lit(""))).alias("payloads"))
    if strict:
        out = out.withColumn("payloads", F.when(F.col("payloads") > 1, F.raise_error(F.lit("one key has different payloads"))).otherwise(F.col("payloads")))
    return out


def best_text(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Per key the best description: filled before blank, then the longest, then the least."""
    rank = F.struct(F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", 1).otherwise(0).alias("a"), (-F.length(F.coalesce(F.col(text), F.lit("")))).alias("b"), F.coalesce(F.col(text), F.lit("")).alias("c"))
    return df.groupBy(*keys).agg(F.min(rank).alias("_m")).select(*keys, F.col("_m.c").alias(text))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], text: str, date: str) -> DataFrame:
    """The rule table after an update: new rows replace old ones of their key; an unchanged text keeps its old date."""
    o = old.select(*keys, F.col(text).alias("_text"), F.col(date).alias("_date"), F.lit(True).alias("_old"))
    n = new.withColumn("_new", F.lit(True))
    j = o.join(n, list(keys), "full_outer")
    same = F.col("_new").isNull() | F.col("_text").eqNullSafe(F.col(text))
    return j.select(*keys, F.when(F.col("_new").isNull(), F.col("_text")).otherwise(F.col(text)).alias(text), F.when(F.col("_old") & same, F.col("_date")).otherwise(F.col(date)).alias(date))
