"""Instants from numbers and texts under one of several rules, and their one rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From which magnitude on a number counts milliseconds, microseconds and nanoseconds, by rule.
EPOCH_RULES = {"row": (10**11, 10**14, 10**17), "hunt": (10**12, 10**15, 10**18)}
#: Digits of seconds, milliseconds, microseconds and nanoseconds in the rule by length.
EPOCH_DIGITS = {10: 1_000_000, 13: 1_000, 16: 1, 19: 0}


def epoch_micros(c: Column, rule: str = "row") -> Column:
    """Microseconds of a number of seconds or finer units. `row` takes ≥, `hunt` takes > as the bound; `digits` goes by length
    and gives null for other lengths."""
    n = c.cast("long")
    if rule == "digits":
        size = F.length(n.cast("string"))
        out = F.when(size == 19, F.floor(n / F.lit(1000).cast("decimal(4,0)")).cast("long"))
        for d, scale in EPOCH_DIGITS.items():
            if scale:
                out = out.when(size == d, n * scale)
        return out
    ms, us, ns = EPOCH_RULES[rule]
    over = (lambda x: F.abs(n) >= x) if rule == "row" else (lambda x: F.abs(n) > x)
    thousandth = F.floor(n / F.lit(1000).cast("decimal(4,0)")).cast("long")
    return F.when(over(ns), thousandth).when(over(us), n).when(over(ms), n * 1000).otherwise(n * 1_000_000)


def iso_micros(c: Column, naive: str = "utc") -> Column:
    """Microseconds of an ISO text; `naive` texts without an offset are UTC or, with "reject", null."""
    zoned = c.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$")
    t = F.unix_micros(F.try_to_timestamp(c))
    return F.when(zoned, t) if naive == "reject" else t


def utc_text(micros: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffffZ of microseconds, whatever the session's zone."""
    ntz = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
