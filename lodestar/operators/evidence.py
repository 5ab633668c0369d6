"""Evidence records: deduplication with provenance, ranges, ordered packing and selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.numbering import numbered, numbered_within


def dedup_evidence(df: DataFrame, content: Sequence[str], time: str) -> DataFrame:
    """evidence_id, occurrences, first_seen, last_seen per distinct content; the id is `ev-` and 24 digits of its SHA-256.

    Contents are hashed before the shuffle, so long texts don't cross it. Null and empty contents are alike.
    """
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    t = F.col(time).cast("string")
    return df.select(h.alias("h"), t.alias("t")).groupBy("h").agg(F.count("*").alias("occurrences"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen")).select(F.concat(F.lit("ev-"), F.left("h", F.lit(24))).alias("evidence_id"), "occurrences", "first_seen", "last_seen")


def line_ranges(df: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """keys and `ranges`: the distinct lines of each group, consecutive ones as `a-b`, joined by commas.

    Lines become islands by a window per key, and only islands, not lines, are brought together.
    """
    d = df.where(F.col(line) > 0).select(*keys, F.col(line).cast("long").alias("l")).distinct()
    w = Window.partitionBy(*keys).orderBy("l")
    isl = d.withColumn("i", F.col("l") - F.row_number().over(w)).groupBy(*keys, "i").agg(F.min("l").alias("a"), F.max("l").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return isl.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("x")).select(*keys, F.array_join(F.transform("x", lambda s: s["t"]), ",").alias("ranges"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") == 1).drop("_r")


def numbered_then_filtered(df: DataFrame, source: Sequence[str], order: Sequence[str], cond: Column) -> DataFrame:
    """Rows that satisfy cond with row_ref, their ordinal within the source before filtering."""
    return df.withColumn("row_ref", F.row_number().over(Window.partitionBy(*source).orderBy(*order))).where(cond)


def segments(df: DataFrame, source: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """source, segment (from 0), row_start, row_end, n: bounded row ranges of every source, however large."""
    r = numbered_within(df.select(*source, *order), source, order, "_n")
    return r.groupBy(*source, F.floor((F.col("_n") - 1) / size).alias("segment")).agg(F.min("_n").alias("row_start"), F.max("_n").alias("row_end"), F.count("*").alias("n"))


def bounded_prefix(df: DataFrame, source: Sequence[str], order: Sequence[str], weight: Column, most: int, rows: int) -> DataFrame:
    """The leading rows of each source whose weights sum to at most `most`, at most `rows` of them."""
    w = Window.partitionBy(*source).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"_s": F.sum(weight).over(run), "_r": F.row_number().over(w)}).where((F.col("_s") <= most) & (F.col("_r") <= rows)).drop("_s", "_r")


def pack(df: DataFrame, source: str, order: Sequence[str], weight: Column, most: int) -> DataFrame:
    """(source, chunk, row_start, row_end, rows, weight): greedy packing of each source's rows, in order, up to `most` a chunk.

    Packing restarts when a chunk is full, which no window function expresses. Rows are sorted by source across the cluster and
    each partition packs its sources in one pass, holding one chunk's counters. A row above the limit is a chunk of its own.
    """
    w = df.select(F.col(source).cast("string").alias("source"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], weight.cast("long").alias("w"))
    s = w.repartition("source").sortWithinPartitions("source", *[f"_o{i}" for i in range(len(order))]).select("source", "w")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["source", "chunk", "row_start", "row_end", "n", "weight"]
        now, chunk, start, at, total = None, 0, 0, 0, 0
        for f in frames:
            out = []
            for src, x in zip(f["source"], f["w"].fillna(0).astype(int), strict=True):
                src = None if pd.isna(src) else src
                if at and src != now:
                    out.append((now, chunk, start + 1, at, at - start, total))
                    chunk = start = at = total = 0
                elif at > start and total + x > most:
                    out.append((now, chunk, start + 1, at, at - start, total))
                    chunk, start, total = chunk + 1, at, 0
                now, at, total = src, at + 1, total + x
            yield pd.DataFrame(out, columns=cols)
        if at:
            yield pd.DataFrame([(now, chunk, start + 1, at, at - start, total)], columns=cols)

    return s.mapInPandas(run, "source string, chunk int, row_start long, row_end long, n long, weight long")


def select_in_budget(df: DataFrame, source: str, order: Sequence[Column], weight: Column, budget: int, keep: str) -> DataFrame:
    """(source, keep): rows taken in order while they fit the source's budget; one that doesn't fit is passed over.

    Each source is walked once in order; only the sum is held. Rows that no budget holds are left out before.
    """
    w = df.select(F.col(source).cast("string").alias("source"), F.col(keep).cast("string").alias("keep"), weight.cast("long").alias("w"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    w = w.where(F.coalesce("w", F.lit(0)) <= budget)
    s = w.repartition("source").sortWithinPartitions("source", *[f"_o{i}" for i in range(len(order))]).select("source", "keep", "w")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, begun, used = None, False, 0
        for f in frames:
            out = []
            for src, k, x in zip(f["source"], f["keep"], f["w"].fillna(0).astype(int), strict=True):
                src = None if pd.isna(src) else src
                if not begun or src != now:
                    now, begun, used = src, True, 0
                if used + x <= budget:
                    used += x
                    out.append((src, k))
            yield pd.DataFrame(out, columns=["source", "keep"])

    return s.mapInPandas(run, "source string, keep string")


def diverse(df: DataFrame, keys: Sequence[str], host: str, order: Sequence[str], most: int) -> DataFrame:
    """Up to `most` rows per key: the first of every host in order, then the key's first, middle and last rows.

    Places are numbered across partitions; what competes for a key's places is one row per host, of which the planner keeps
    `most` before it brings them together.
    """
    r = numbered_within(df, keys, order, "_r")
    first = r.groupBy(*keys, host).agg(F.min("_r").alias("_r")).select(*keys, "_r", F.lit(0).alias("_h"))
    n = r.groupBy(*keys).agg(F.count("*").alias("_n"))
    ends = n.select(*keys, F.explode(F.array(F.lit(1).cast("long"), F.floor(F.col("_n") / 2) + 1, F.col("_n"))).alias("_r"), F.lit(1).alias("_h"))
    pick = first.unionByName(ends).groupBy(*keys, "_r").agg(F.min("_h").alias("_h"))
    w = Window.partitionBy(*keys).orderBy("_h", "_r")
    pick = pick.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    pick = pick.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_r").alias("_at"))
    on = F.col("_r") == F.col("_at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return r.join(pick, on, "left_semi").select(*df.columns)


def alias_new(ids: DataFrame, existing: DataFrame, id_col: str) -> DataFrame:
    """(id, alias): ids keep their alias; new ones get the next numbers in order of id."""
    top = existing.agg(F.coalesce(F.max("alias"), F.lit(0)).cast("long")).scalar()
    fresh = numbered(ids.select(id_col).distinct().join(existing, id_col, "left_anti"), [id_col])
    return existing.select(id_col, F.col("alias").cast("long").alias("alias")).unionByName(fresh.select(id_col, (F.col("n") + top).cast("long").alias("alias")))
