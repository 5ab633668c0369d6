"""Column builders for the canonical forms that copies are compared by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields that make two rules the same, by the letters of their names.
RULE_FIELDS = ("category", "imagepath", "launchstring", "signer")


def letters_digits(c: Column) -> Column:
    """The letters and digits of c in lower case, in order. Null gives the empty string."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]+", "")


def _named(c: Column, name: str, pairs: Column) -> Column:
    """The value of the first pair whose name, letters only, is `name`; else c."""
    hit = F.filter(pairs, lambda p: F.regexp_replace(F.lower(p["key"]), "[^a-z]+", "") == F.lit(name))
    return F.coalesce(c, F.try_element_at(hit, F.lit(1))["value"])


def record_pairs(text: Column) -> Column:
    """Name and value pairs of a whole record held as text: a JSON object, or `Name=value` joined by a bar.

    A bar starts a new pair only where a name and an equals sign follow, so a bar inside a value stays in it.
    Text in neither form, and null, give null.
    """
    as_json = F.map_entries(F.from_json(text, "map<string,string>"))
    parts = F.split(text, r"\|(?=\s*[A-Za-z][A-Za-z _]*=)")
    as_bars = F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1).alias("value"),
        ),
    )
    return F.when(F.ltrim(text).startswith("{"), as_json).otherwise(as_bars)


def rule_key(category: Column, image_path: Column, launch_string: Column, signer: Column, record_text: Column) -> Column:
    """One canonical text of a rule, from its columns or else from record_text; fields are parted by a unit separator.

    The record is parsed only in rows that have one.
    """
    pairs = F.when(record_text.isNotNull(), record_pairs(record_text))
    cols = dict(zip(RULE_FIELDS, (category, image_path, launch_string, signer), strict=True))
    plain = F.concat_ws("\x1f", *[letters_digits(c) for c in cols.values()])
    parsed = F.concat_ws("\x1f", *[letters_digits(_named(c, n, pairs)) for n, c in cols.items()])
    return F.when(record_text.isNull(), plain).otherwise(parsed)
