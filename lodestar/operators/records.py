"""Records as text and as references: search with context, line protocols, comparisons, budgets, pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.numbering import numbered

#: Seconds of the units of a duration.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def duration_seconds(text: Column) -> Column:
    """Seconds of `30m`, `2h`, `1d` or `45s`, whatever case and blanks around; null for any other text."""
    t = F.lower(F.trim(text))
    unit = F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), F.right(t, F.lit(1)))
    return F.when(t.rlike(r"\A\d+[smhd]\z"), F.substring(t, 1, 18).substr(F.lit(1), F.length(t) - 1).try_cast("long") * unit)


def dotted(c: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; a text on the way that is JSON itself is looked into."""
    for part in path.split("."):
        c = F.get_json_object(c, f"$['{part}']")
    return c


def first_alias(record: Column, names: Sequence[str]) -> Column:
    """The value of the first of several names that a JSON record has with a value."""
    return F.coalesce(*[F.get_json_object(record, f"$['{n}']") for n in names])


def tab_fields(line: Column, names: Sequence[str]) -> list[Column]:
    """The fields of a tab-separated line; the last holds the rest of it, tabs included. Null where the line is too short."""
    parts = F.split(line, "\t", len(names))
    return [F.when(F.size(parts) == len(names), parts[i]).alias(n) for i, n in enumerate(names)]


def any_rule(rules: Column, matches: Callable[[Column], Column]) -> Column:
    """Whether any rule of an array matches; null rules and no rules don't."""
    return F.coalesce(F.exists(rules, lambda r: F.coalesce(matches(r), F.lit(False))), F.lit(False))


def search(df: DataFrame, id_col: str, fields: Sequence[str], literals: Sequence[str] = (), patterns: Sequence[str] = (), context: int = 80, case_sensitive: bool = False) -> DataFrame:
    """(id, field, kind, pattern, start, stop, match, before, after) of every match in every field; places count from 0.

    before and after hold up to `context` characters around the match. Matches of one pattern don't overlap, empty ones are
    left out; null and empty fields have none. A report limits the result with `probe`.
    """
    flags = 0 if case_sensitive else re.IGNORECASE
    specs = [("literal", x, re.escape(x)) for x in literals] + [("regex", x, x) for x in patterns]
    for _, _, p in specs:
        re.compile(p, flags)
    names = ["id", "field", "kind", "pattern", "start", "stop", "match", "before", "after"]
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select("id", "x.*").where("v <> ''")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(k, x, re.compile(p, flags)) for k, x, p in specs]
        for f in frames:
            out = [
                (i, field, k, x, m.start(), m.end(), m.group(), v[max(0, m.start() - context) : m.start()], v[m.end() : m.end() + context])
                for i, field, v in zip(f["id"], f["field"], f["v"], strict=True)
                for k, x, r in compiled
                for m in r.finditer(v)
                if m.end() > m.start()
            ]
            yield pd.DataFrame(out, columns=names)

    kind = dict(df.dtypes)[id_col]
    return long.mapInPandas(run, f"id {kind}, field string, kind string, pattern string, start int, stop int, match string, before string, after string")


def mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows of left with `found` (right has the keys) and `differ`, the fields whose values differ, in order.

    right has one row per key. A row with `differ` empty matches as a whole; null equals null; null keys match nothing.
    """
    r = right.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    j = left.join(r, list(keys), "left")
    differ = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    found = F.coalesce("_there", F.lit(False))
    return j.select(*left.columns, found.alias("found"), F.when(found, differ).otherwise(F.array().cast("array<string>")).alias("differ"))


def repair_references(refs: DataFrame, known: DataFrame, ref: str = "ref") -> DataFrame:
    """refs with `repaired`: a reference S<n>-R<m> in the padding that a known one has, if only one known one has its numbers."""
    form = r"\AS([0-9]{1,20})-R([0-9]{1,20})\z"

    def number(i: int) -> Column:
        return F.regexp_replace(F.regexp_extract(ref, form, i), r"^0+(?=\d)", "")

    k = known.where(F.col(ref).rlike(form)).select(number(1).alias("_s"), number(2).alias("_r"), F.col(ref).alias("_ref"))
    k = k.groupBy("_s", "_r").agg(F.min("_ref").alias("_ref"), F.max("_ref").alias("_z")).where("_ref = _z").drop("_z")
    j = refs.withColumns({"_s": F.when(F.col(ref).rlike(form), number(1)), "_r": number(2)}).join(k, ["_s", "_r"], "left")
    return j.select(*refs.columns, F.coalesce("_ref", F.col(ref)).alias("repaired"))


def fair_shares(demands: DataFrame, key: str, demand: str, total: int) -> DataFrame:
    """key, demand, share: a total given out fairly. Small demands are met, all others get the same; what can't be divided goes, one
    each, to the first of these by key. Null and negative demands count as 0.

    The common level is found from running totals over the sorted demands, which are numbered across partitions.
    """
    d = demands.select(key, F.greatest(F.coalesce(F.col(demand), F.lit(0)), F.lit(0)).cast("long").alias(demand))
    s = numbered(d, [demand, key], "n", F.col(demand))
    count = d.agg(F.count("*")).scalar()
    own = F.floor((F.lit(total) - (F.col("n_sum") - F.col(demand))) / (count - F.col("n") + 1)).cast("long")
    level = s.where(F.col(demand) > own).agg(F.max(own)).scalar()
    met = s.withColumn("share", F.least(F.col(demand), F.greatest(F.coalesce(level, F.col(demand)), F.lit(0))))
    rest = F.lit(total) - met.agg(F.sum("share")).scalar()
    short = numbered(met.where(F.col("share") < F.col(demand)).select(key), [key], "_k").select(F.col(key).alias("_key"), "_k")
    out = met.join(short, met[key] == short["_key"], "left")
    return out.select(key, demand, (F.col("share") + F.when(F.col("_k") <= rest, 1).otherwise(0)).alias("share"))


def page(df: DataFrame, order: Sequence[str], facets: Mapping[str, object], offset: int, size: int, text: str, most_bytes: int = 96_000, preview: int = 2048) -> DataFrame:
    """One page of the rows that have all facets: `size` rows after `offset`, fewer where their texts exceed most_bytes.

    text is cut to `preview` characters, with `clipped`; the first row comes whatever its size. matching is the number of all rows
    with the facets, next_offset where the next page begins, null after the last.
    """
    if offset < 0 or not 1 <= size <= 200:
        raise ValueError("an offset of 0 or more and 1 to 200 rows")
    for name, value in facets.items():
        df = df.where(F.col(name) == F.lit(value))
    matching = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset(offset).limit(size)
    rows = rows.withColumns({"clipped": F.coalesce(F.length(text) > preview, F.lit(False)), text: F.substring(text, 1, preview)})
    w = Window.partitionBy(F.lit(1)).orderBy(*order)  # over one page
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = rows.withColumns({"_at": F.row_number().over(w), "_sum": F.sum(bytes_).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    rows = rows.where((F.col("_at") == 1) | (F.col("_sum") <= most_bytes))
    shown = F.count("*").over(Window.partitionBy(F.lit(1)))
    after = F.lit(offset) + shown
    return rows.withColumns({"matching": matching, "next_offset": F.when(after < matching, after)}).drop("_at", "_sum")


def classified(groups: DataFrame, rule: Callable[[pd.DataFrame], pd.Series], name: str = "verdict") -> DataFrame:
    """groups with a verdict per row by a classifier that sees Arrow batches of distinct groups; any model can stand behind `rule`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{name: rule(f).astype(object)})

    return groups.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in groups.dtypes) + f", `{name}` string")
