"""Identities: hashes over canonical texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import ascii_lower, identity_path

#: What a JSON text writes for the signs that it escapes, HTML-sensitive ones included.
_SHORT = {"\n": "n", "\r": "r", "\t": "t", "\b": "b", "\f": "f"}
_HTML = "&<>\u2028\u2029"


def json_string(c: Column) -> Column:
    """c as a JSON string; &, <, > and the line separators are escaped too."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    out = plain
    for ch, letter in _SHORT.items():
        out = F.replace(out, F.lit(ch), F.lit("\\" + letter))
    for code in [*range(32), *map(ord, _HTML)]:
        if chr(code) not in _SHORT:
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    # Few texts hold any of these signs; only they are taken through all replacements.
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f&<>\u2028\u2029]"), out).otherwise(plain), F.lit('"'))


def identity_key(image_path: Column, launch_string: Column, signer: Column) -> Column:
    """SHA-1 of the identity of a start entry: its normalised paths and folded signer as JSON indented by one blank."""
    parts = {"ImagePath": identity_path(image_path), "LaunchString": identity_path(launch_string), "Signer": ascii_lower(F.coalesce(signer, F.lit("")))}
    body: list[Column] = [F.lit("{\n")]
    for i, (name, c) in enumerate(parts.items()):
        body += [F.lit(f' "{name}": '), json_string(c), F.lit(",\n" if i < 2 else "\n}")]
    return F.sha1(F.concat(*body))


def prefixed_id(prefix: str, cols: Sequence[Column], digits: int = 32) -> Column:
    """`prefix` and the first digits of the SHA-256 of the values, each ended by a zero character; null counts as empty."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat(*[x for c in cols for x in (F.coalesce(c.cast("string"), F.lit("")), F.lit("\0"))]), 256), F.lit(digits)))


def set_fingerprint(values: Column) -> Column:
    """SHA-256 of an array's distinct values, sorted, one per line."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)
