"""Filters: each function builds a Column, so that predicates reach the scan."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conds: Sequence[Column]) -> Column:
    """The conjunction; true of none."""
    return reduce(lambda a, b: a & b, conds, F.lit(True)) if conds else F.lit(True)


def any_of(conds: Sequence[Column]) -> Column:
    """The disjunction; false of none."""
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def dimension_equals(c: Column, value: str) -> Column:
    """Equality of a stack dimension; the empty value stands for null and empty."""
    return (c.isNull() | (c == "")) if value == "" else (c == value)


def residual(reviewed: Column, known_bad: Column) -> Column:
    """What is left to review: all that `reviewed` doesn't cover, and known-bad rows always. Null covers nothing."""
    return ~F.coalesce(reviewed, F.lit(False)) | F.coalesce(known_bad, F.lit(False))


def open_interval(roles: Sequence[Column], after: Column | None, before: Column | None) -> Column:
    """Whether any of the times lies strictly between the bounds; an open bound doesn't bind, a null time never lies there."""
    return any_of([c.isNotNull() & all_of([x for x in ((c > after) if after is not None else None, (c < before) if before is not None else None) if x is not None]) for c in roles])


def has_labels(c: Column, required: Sequence[str], excluded: Sequence[str]) -> Column:
    """All required labels and none of the excluded; a null list has no labels."""
    have = F.coalesce(c, F.array().cast("array<string>"))
    need, avoid = F.array(*map(F.lit, required)).cast("array<string>"), F.array(*map(F.lit, excluded)).cast("array<string>")
    return (F.size(F.array_except(need, have)) == 0) & ~F.arrays_overlap(have, avoid)


def under(c: Column, parent: str) -> Column:
    """The artifact itself or one of its components `parent/...`."""
    return (c == parent) | c.startswith(f"{parent}/")


def anywhere(df: DataFrame, literal: str) -> Column:
    """Whether the literal occurs in any value or name of a row, whatever the case; quotes and backslashes stand for themselves.

    Lists, maps and structs are looked through as JSON, with the literal written as JSON does.
    """
    low = literal.lower()
    if any(low in c.lower() for c in df.columns):
        return F.lit(True)
    quoted = json.dumps(low, ensure_ascii=False)[1:-1]
    hits = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        nested = kind.startswith(("array", "map", "struct", "variant"))
        hits.append(F.coalesce(F.lower(F.to_json(c) if nested else c.cast("string")).contains(quoted if nested else low), F.lit(False)))
    return any_of(hits)


def reasons(codes: Mapping[str, Column]) -> Column:
    """The codes whose conditions hold, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, code) for code, cond in codes.items()]))


def text_matches(df: DataFrame, id_col: str, fields: Sequence[str], patterns: Mapping[str, str]) -> DataFrame:
    """Every match of every pattern in every field: (id, field, pattern, nth, match), nth from 1 in each field's text.

    One pass over the rows; patterns are literals, compiled once per task. Null texts have no match.
    """
    found = [_matches(f, name, p) for f in fields for name, p in patterns.items()]
    return df.select(F.col(id_col), F.explode(F.flatten(F.array(*found))).alias("m")).select(id_col, "m.*")


def _matches(field: str, name: str, pattern: str) -> Column:
    all_ = F.coalesce(F.regexp_extract_all(F.col(field), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    return F.transform(all_, lambda m, i: F.struct(F.lit(field).alias("field"), F.lit(name).alias("pattern"), (i + 1).alias("nth"), m.alias("match")))


def exclude_keys(df: DataFrame, reviewed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't among the reviewed ones; null keys match null keys."""
    r = reviewed.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
    return df.join(r, all_of([df[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]), "left_anti")
