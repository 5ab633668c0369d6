"""Duplicates hidden by formatting: one record each, with the exact number of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.canonical import letters_digits, rule_key
from lodestar.llm.runs import adjacent_runs


def rule_keys(rules: DataFrame) -> DataFrame:
    """(id, key) of golden rules; key never null."""
    return rules.select(F.col("rule_id").alias("id"), rule_key(*[F.col(c) for c in ("category", "image_path", "launch_string", "signer", "record_text")]).alias("key"))


def hash_keys(known: DataFrame) -> DataFrame:
    """(id, key) of known-good records; a hash_key without letters and digits gives a null key, which is no case."""
    k = letters_digits(F.col("hash_key"))
    return known.select(F.col("record_id").alias("id"), F.when(k != "", k).alias("key"))


def collapse(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, representatives) of (id, key) rows.

    copies(id, first_id): every record that is not the first of its copies. representatives(first_id, n): the record with
    the smallest id of each key and how many records share it. Rows delivered twice are one record; null keys and null ids
    are left out; other columns of `keyed` are ignored, whatever their names.
    """
    return adjacent_runs(keyed, F.col("key"), F.col("id"), F.col("id"))


def copies_found(rules: DataFrame, known: DataFrame) -> DataFrame:
    """p3_found: (table_name, first_id, copy_id)."""
    out = None
    for name, keyed in (("golden_rules", rule_keys(rules)), ("autoruns_known_good", hash_keys(known))):
        part = collapse(keyed)[0].select(F.lit(name).alias("table_name"), "first_id", F.col("id").alias("copy_id"))
        out = part if out is None else out.unionByName(part)
    return out


def records_collapsed(rules: DataFrame, known: DataFrame) -> DataFrame:
    """(table_name, first_id, copies): one record each, by the smallest id of its copies, with their exact number."""
    out = None
    for name, keyed in (("golden_rules", rule_keys(rules)), ("autoruns_known_good", hash_keys(known))):
        part = collapse(keyed)[1].select(F.lit(name).alias("table_name"), "first_id", F.col("n").alias("copies"))
        out = part if out is None else out.unionByName(part)
    return out
