"""Stacking: frequency and prevalence of value combinations, and what reduces them for review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.predicates import reasons


@dataclass(frozen=True)
class StackSpec:
    """A stack over a table: dimensions, the host column, a time column and how many groups are kept."""

    name: str
    dims: Sequence[str]
    host: str
    time: str | None = None
    max_groups: int = 100
    metrics: dict[str, str] = field(default_factory=dict)


def count_stack(df: DataFrame, dims: Sequence[str], count: str = "n") -> DataFrame:
    """Rows per combination."""
    return df.groupBy(*dims).agg(F.count("*").alias(count))


def prevalence(df: DataFrame, dims: Sequence[str], host: str) -> DataFrame:
    """dims, host_count, n: hosts (a null host is one) and rows per combination.

    Two levels, so that a hot combination is spread over its hosts before it is brought together.
    """
    return df.groupBy(*dims, host).count().groupBy(*dims).agg(F.count("*").alias("host_count"), F.sum("count").alias("n"))


def host_percent(hosts: Column, denominator: Column) -> Column:
    """Share of hosts in percent with two digits; 0 without a denominator."""
    return F.when(denominator > 0, F.round(hosts / denominator * 100, 2)).otherwise(F.lit(0.0))


def sample_of(c: Column, most: int) -> Column:
    """The first `most` distinct values in order: a choice that doesn't depend on how rows arrive."""
    return F.slice(F.array_sort(F.collect_set(c)), 1, most)


def bounded_sample(df: DataFrame, dims: Sequence[str], value: str, most: int) -> DataFrame:
    """dims and `sample`, the least `most` distinct values of each group, never holding more than that for a group."""
    w = Window.partitionBy(*dims).orderBy(value)
    least = df.where(F.col(value).isNotNull()).select(*dims, value).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return least.groupBy(*dims).agg(F.array_sort(F.collect_list(value)).alias("sample"))


#: Up to so many rules are written into the plan as literals, whose patterns are compiled once per task.
LITERAL_RULES = 200


def unmatched(groups: DataFrame, rules: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Groups that no rule fully matches in all its fields, whatever the case; a null field counts as empty, null rules don't match.

    Few rules become literal predicates; more are joined, where every pair compiles its pattern anew.
    """
    few = rules.select(*pairs.values()).distinct().limit(LITERAL_RULES + 1).collect()

    def full(c: Column, pattern: Column) -> Column:
        return F.regexp_like(F.coalesce(c, F.lit("")), F.concat(F.lit(r"(?is)\A(?:"), pattern, F.lit(r")\z")))

    if len(few) <= LITERAL_RULES:
        out = groups
        for rule in few:
            if all(rule[r] is not None for r in pairs.values()):
                hit = F.lit(True)
                for g, r in pairs.items():
                    hit = hit & F.coalesce(F.col(g), F.lit("")).rlike(rf"(?is)\A(?:{rule[r]})\z")
                out = out.where(~hit)
        return out
    cond = F.lit(True)
    for g, r in pairs.items():
        cond = cond & full(groups[g], rules[r])
    return groups.join(rules, cond, "left_anti")


def accounted_stack(rows: DataFrame, dims: Sequence[str], host: str, rules: DataFrame, pairs: dict[str, str], cutoff: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """(residual stack, accounts) where every row is accounted for.

    Rows are counted by identity first; groups above `cutoff` rows are set aside, the rest are matched against the rules, and
    what no rule matches is the residual, with up to `samples` host names. The patterns come last and see each identity once.
    accounts has one row: eligible = excluded + matched + residual, in rows and in groups.
    """
    by_host = rows.groupBy(*dims, host).agg(F.count("*").alias("_c"))
    groups = by_host.groupBy(*dims).agg(F.sum("_c").alias("total_rows"))
    if cutoff > 0:
        # What is left has at most `cutoff` rows a group: the sample comes from the same pass.
        total = F.sum("_c").over(Window.partitionBy(*dims))
        open_ = by_host.withColumn("_t", total).where(F.col("_t") <= cutoff).groupBy(*dims).agg(F.max("_t").alias("total_rows"), F.slice(F.array_sort(F.collect_set(host)), 1, samples).alias("example_hosts"))
        stack = unmatched(open_, rules, pairs)
        left = unmatched(groups.where(F.col("total_rows") <= cutoff), rules, pairs)
    else:
        left = unmatched(groups, rules, pairs)
        names = bounded_sample(rows, dims, host, samples)
        on = [left[d].eqNullSafe(names[d]) for d in dims]
        stack = left.join(names, on, "left").select(*[left[d] for d in dims], "total_rows", F.coalesce("sample", F.array().cast("array<string>")).alias("example_hosts"))
    all_ = groups.agg(F.sum("total_rows").alias("eligible_rows"), F.count("*").alias("eligible_groups"))
    out = groups.where(F.col("total_rows") > cutoff).agg(F.coalesce(F.sum("total_rows"), F.lit(0)).alias("excluded_rows"), F.count("*").alias("excluded_groups")) if cutoff > 0 else groups.limit(1).agg(F.lit(0).alias("excluded_rows"), F.lit(0).alias("excluded_groups"))
    rest = left.agg(F.coalesce(F.sum("total_rows"), F.lit(0)).alias("residual_rows"), F.count("*").alias("residual_groups"))
    # One row each, brought together by their only values.
    three = all_.unionByName(out, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)
    accounts = three.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in three.columns])
    return stack, accounts.withColumns(
        {
            "matched_rows": F.col("eligible_rows") - F.col("excluded_rows") - F.col("residual_rows"),
            "matched_groups": F.col("eligible_groups") - F.col("excluded_groups") - F.col("residual_groups"),
        }
    )


def stack_view(df: DataFrame, spec: StackSpec) -> DataFrame:
    """One stack: view, key (dimensions joined), n, hosts, first_seen, last_seen; the top groups by count, then key.

    Rows with an empty dimension are not stacked. First and last seen compare as texts.
    """
    filled = df
    for d in spec.dims:
        filled = filled.where(F.col(d).isNotNull() & (F.col(d).cast("string") != ""))
    t = F.col(spec.time).cast("string") if spec.time else F.lit(None).cast("string")
    key = F.concat_ws(" | ", *[F.col(d).cast("string") for d in spec.dims])
    by_host = filled.groupBy(key.alias("key"), spec.host).agg(F.count("*").alias("c"), F.min(t).alias("a"), F.max(t).alias("z"))
    g = by_host.groupBy("key").agg(F.sum("c").alias("n"), F.count(spec.host).alias("hosts"), F.min("a").alias("first_seen"), F.max("z").alias("last_seen"))
    return g.orderBy(F.desc("n"), "key").limit(spec.max_groups).select(F.lit(spec.name).alias("view"), "*")


def stack_totals(df: DataFrame, spec: StackSpec) -> DataFrame:
    """view, rows_seen, rows_stacked, rows_unstacked, group_count, truncated of one stack."""
    filled = F.lit(True)
    for d in spec.dims:
        filled = filled & F.col(d).isNotNull() & (F.col(d).cast("string") != "")
    g = df.groupBy(*spec.dims).agg(F.count("*").alias("c"), F.first(filled).alias("f"))
    return g.agg(
        F.lit(spec.name).alias("view"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows_seen"),
        F.coalesce(F.sum(F.when(F.col("f"), F.col("c"))), F.lit(0)).alias("rows_stacked"),
        F.coalesce(F.sum(F.when(~F.col("f"), F.col("c"))), F.lit(0)).alias("rows_unstacked"),
        F.count_if("f").alias("group_count"),
        (F.count_if("f") > spec.max_groups).alias("truncated"),
    )


def discovery(df: DataFrame, detection: str, evidence: str, large: int = 4096) -> DataFrame:
    """Per detection (null and empty are one): rows, total and longest evidence, rows above `large` characters."""
    size = F.coalesce(F.length(evidence), F.lit(0)).cast("long")
    return df.groupBy(F.coalesce(detection, F.lit("")).alias("detection")).agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.max(size).alias("longest"), F.count_if(size > large).alias("large_rows"))


def census(df: DataFrame, dims: Sequence[str], evidence: str) -> DataFrame:
    """Per dims: distinct evidence texts, rows, texts seen once, the most frequent text's rows."""
    g = df.groupBy(*dims, evidence).count()
    return g.groupBy(*dims).agg(F.count("*").alias("group_count"), F.sum("count").alias("row_count"), F.count_if(F.col("count") == 1).alias("singletons"), F.max("count").alias("largest"))


def stack_or_direct(c: DataFrame, rows: int = 1000, chunk_rows: int = 100, chunks: int = 10, reduction: int = 100, share: float = 0.05) -> DataFrame:
    """A census with `route`: `stack` where enough rows and chunks are saved by reviewing groups, else `direct`."""
    saved = F.col("row_count") - F.col("group_count")
    enough = (F.col("row_count") >= rows) & (F.ceil(F.col("row_count") / chunk_rows) >= chunks) & (saved >= reduction) & (saved / F.col("row_count") >= share)
    return c.withColumns({"saved": saved, "route": F.when(enough, "stack").otherwise("direct")})


def signatures(df: DataFrame, scope: str, dims: Sequence[str], top: int = 5, repetitive: float = 0.80, mixed: float = 0.30) -> DataFrame:
    """Per scope: how far its `top` most frequent signatures reach.

    scope, row_count, signatures, leading (signatures taken), leading_rows, coverage and class: repetitive (only the shortest
    prefix that reaches the bound is taken), mixed or unique.
    """
    g = df.groupBy(scope, *dims).count()
    whole = g.groupBy(scope).agg(F.sum("count").alias("row_count"), F.count("*").alias("signatures"))
    w = Window.partitionBy(scope).orderBy(F.desc("count"), *dims)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = g.select("*", F.row_number().over(w).alias("r")).where(F.col("r") <= top).select("*", F.sum("count").over(run).alias("run"))
    j = lead.join(whole, scope)
    probe = F.max("run") / F.first("row_count")
    enough = F.min(F.when(F.col("run") / F.col("row_count") >= repetitive, F.col("r")))
    a = j.groupBy(scope).agg(F.first("row_count").alias("row_count"), F.first("signatures").alias("signatures"), probe.alias("p"), enough.alias("e"), F.max("r").alias("most"), F.map_from_entries(F.collect_list(F.struct("r", "run"))).alias("runs"))
    leading = F.when(F.col("p") >= repetitive, F.col("e")).otherwise(F.col("most"))
    return a.select(
        scope,
        "row_count",
        "signatures",
        leading.cast("long").alias("leading"),
        F.element_at("runs", leading).alias("leading_rows"),
        F.round(F.element_at("runs", leading) / F.col("row_count"), 4).alias("coverage"),
        F.when(F.col("p") >= repetitive, "repetitive").when(F.col("p") >= mixed, "mixed").otherwise("unique").alias("class"),
    )


def field_profile(df: DataFrame, fields: Sequence[str], samples: int = 3) -> DataFrame:
    """Per field: rows, nulls, blanks, distinct values, shares, length statistics and the least `samples` values.

    All fields in one pass: values are unpivoted and counted per distinct value first, so hot values cross the shuffle once.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select("x.*")
    per_value = long.groupBy("field", "v").agg(F.count("*").alias("c"))
    filled = F.col("v").isNotNull() & (F.trim("v") != "")
    size = F.when(filled, F.length("v").cast("long"))
    counts = per_value.groupBy("field").agg(
        F.sum("c").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull() & ~filled, F.col("c"))), F.lit(0)).alias("empty_count"),
        F.coalesce(F.sum(F.when(filled, F.col("c"))), F.lit(0)).alias("filled_count"),
        F.count_if(filled).alias("distinct_count"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
    )
    # A limit per field, which every task applies to its own rows first.
    least = per_value.where(filled).withColumn("_r", F.row_number().over(Window.partitionBy("field").orderBy("v"))).where(F.col("_r") <= samples)
    least = least.groupBy("field").agg(F.array_sort(F.collect_list("v")).alias("examples"))
    return counts.join(least, "field", "left").withColumns(
        {
            "examples": F.coalesce("examples", F.array().cast("array<string>")),
            "filled_ratio": F.round(F.col("filled_count") / F.col("row_count"), 6),
            "distinct_ratio": F.when(F.col("filled_count") > 0, F.round(F.col("distinct_count") / F.col("filled_count"), 6)).otherwise(F.lit(0.0)),
        }
    )


def length_percentile(df: DataFrame, fields: Sequence[str], share: float = 0.95) -> DataFrame:
    """Per field: the nearest-rank percentile of the length of its filled values, from counts per length."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select("x.*")
    by_size = long.where("v is not null and trim(v) != ''").groupBy("field", F.length("v").cast("long").alias("size")).count()
    w = Window.partitionBy("field").orderBy("size")
    run = by_size.select("field", "size", F.sum("count").over(w).alias("run"), F.sum("count").over(Window.partitionBy("field")).alias("total"))
    return run.where(F.col("run") >= F.ceil(F.col("total") * share)).groupBy("field").agg(F.min("size").alias("p_length"))


#: Names that make a field no stack dimension, without case, blanks and dashes.
TIME_NAME = r"(?i)(?:^|_)(?:time|timestamp|date|created|creation|modified|mtime|atime|btime|lastseen|firstseen|lastrun)(?:$|_)|(?:time|timestamp|date)$"
TIME_ENDS = ("atime", "btime", "created", "creationtime", "date", "firstseen", "lastmodified", "lastrun", "lastseen", "modified", "mtime", "time", "timestamp")
RECORD_NAME = r"(?i)^(?:row|record|eventrecord|entry|parententry|process|thread)?id$|(?:rowid|recordid|record_id|entrynumber|parententrynumber|pid|ppid|guid|uuid)$"
PROVENANCE = ("artifact", "clientid", "client_id", "computer", "exportcomponent", "flowid", "fqdn", "host", "hostname", "huntid", "orgid", "source", "sourceref", "_sourceref")
PAYLOAD = ("body", "content", "data", "details", "eventdata", "evidence", "message", "payload", "raw", "scriptblocktext", "userdata", "xml")
UNIQUE_IS_FINE = ("application", "appid", "detection", "hash", "md5", "normalized", "processname", "servicename", "sha1", "sha256", "sourceip", "taskname")
SAFE_NAME = r"\A[A-Za-z_][A-Za-z0-9_. -]{0,127}\z"


def rejections(profile: DataFrame, longest: int = 500, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """field and the reasons why it is no stack dimension, from its profile (with p_length) and the types of the columns."""
    low = F.lower(F.regexp_replace("field", "[ -]", ""))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("field")), F.lit("")) if kinds else F.lit("")
    long = F.col("p_length") if "p_length" in profile.columns else F.col("max_length")
    codes = reasons(
        {
            "unsafe_identifier": ~F.col("field").rlike(SAFE_NAME),
            "timestamp_field": F.col("field").rlike(TIME_NAME) | low.rlike(f"(?:{'|'.join(TIME_ENDS)})$"),
            "record_identifier": low.rlike(RECORD_NAME),
            "provenance_only": low.isin(*PROVENANCE),
            "raw_payload": low.startswith("raw") | low.rlike(f"(?:{'|'.join(PAYLOAD)})$"),
            "nested_object": kind.rlike("^(?:struct|map|variant)"),
            "array": kind.startswith("array"),
            "constant": F.col("distinct_count") <= 1,
            "very_sparse": F.col("filled_ratio") < 0.5,
            "excessive_length": F.coalesce(long, F.lit(0)) > longest,
            "mostly_unique_identifier": (F.col("distinct_ratio") >= 0.9) & ~low.rlike("|".join(UNIQUE_IS_FINE)),
        }
    )
    return profile.select("field", F.array_join(codes, ",").alias("codes"))


def selected_context(rows: DataFrame, chosen: DataFrame, keys: Sequence[str], host: str, category: str) -> DataFrame:
    """Per chosen identity: n, hosts (host to rows), categories, and complete: whether it has any row. Null hosts have no entry.

    Rows come down to one per identity, host and category before they meet; a map has as many entries as there are hosts.
    """
    per = rows.join(chosen.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys, host, category).agg(F.count("*").alias("_c"))
    by_host = per.where(F.col(host).isNotNull()).groupBy(*keys, host).agg(F.sum("_c").alias("_c"))
    hosts = by_host.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(host, "_c"))).alias("hosts"))
    rest = per.groupBy(*keys).agg(F.sum("_c").alias("n"), F.array_sort(F.collect_set(category)).alias("categories"))
    j = chosen.select(*keys).distinct().join(rest, list(keys), "left").join(hosts, list(keys), "left")
    return j.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "hosts", "categories", F.col("n").isNotNull().alias("complete"))
