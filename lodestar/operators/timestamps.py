"""Mixed timestamp texts to one UTC instant.

Texts are parsed in the JVM to a local time and either an offset or a zone name. Local times meet the zone's clock in an
as-of join: the offset intervals of every zone, exploded by year, are laid over the local time line, where two intervals
overlap when a clock goes back, none reaches when it goes forward, and one holds otherwise.
"""

from __future__ import annotations

import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Zone abbreviations in use and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "BRT": -180, "ART": -180, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420,
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_DAY_US = 86_400_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Windows ticks of 100 ns between 1601 and 1970.
_TICKS_1970 = 116_444_736_000_000_000
#: Already one unambiguous form.
EXACT = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z|\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+Z\z"

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*(Z|z|[A-Z]{2,5}|(?:UTC|GMT)?[+\-\u2212]\d{2}(?::?\d{2})?)?"
#: Each form with the replacement that brings it to year|month|day|hour|minute|second|fraction|half|zone.
FORMS = (
    ("iso", rf"\A(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_TIME}{_AMPM}{_ZONE}\z", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("compact", r"\A(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?\s*(Z|z|[+\-]\d{2}(?::?\d{2})?)?\z", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("dotted", rf"\A(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?\z", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("slashed", rf"\A(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?\z", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("named", rf"\A([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?\z", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("mail", rf"\A(?:[A-Za-z]{{3}}[a-z]*,?\s+)?(\d{{1,2}})[ \-]([A-Za-z]{{3}})[a-z]*\.?[ \-](\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?\z", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("date", r"\A(\d{4})-(\d{1,2})-(\d{1,2})\z", "$1|$2|$3||||||"),
    ("yearfirst", rf"\A(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?\z", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
)


def _rules(name: str) -> bytes:
    """The file of a zone; its name where there is none."""
    for folder in zoneinfo.TZPATH:
        path = Path(folder, name)
        if path.is_file():
            return path.read_bytes()
    return name.encode()


def _listed(rules: bytes) -> list[tuple[int, int, int]]:
    """(second, offset before, offset after) of the changes that a zone file lists; its 64-bit part, as RFC 8536 lays it out."""
    if rules[:4] != b"TZif" or rules[4:5] < b"2":
        return []
    counts = struct.unpack(">6l", rules[20:44])
    at = 44 + counts[3] * 5 + counts[4] * 6 + counts[5] + counts[2] * 8 + counts[1] + counts[0]
    counts = struct.unpack(">6l", rules[at + 20 : at + 44])
    times, kinds = counts[3], counts[4]
    at += 44
    when = struct.unpack(f">{times}q", rules[at : at + 8 * times])
    which = rules[at + 8 * times : at + 9 * times]
    offsets = [struct.unpack(">l", rules[at + 9 * times + 6 * k :][:4])[0] for k in range(kinds)]
    after = [offsets[k] for k in which]
    return [(t, a, b) for t, a, b in zip(when, [offsets[0], *after], after, strict=False) if a != b]


#: Years whose clock changes are laid out; before and after, the first and the last offset go on.
FIRST_YEAR, LAST_YEAR = 1900, 2100


@lru_cache(maxsize=4)
def zone_segments(first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> tuple[dict[str, int], list[tuple[int, int, int, int, int, str]]]:
    """(clock of each IANA zone, segments): the local time lines of all clocks without gap or overlap; many zones share a clock.

    A segment is (clock, year, start_us, end_us, offset_us, kind). kind is `one`, `two` (local times that two offset intervals
    hold) or `none` (those that none holds); the offset of the last two is the one in force before the change. The first and
    last segment of a clock reach without end. Bounded by the zone data and the years, not by any table.
    """
    far, step = 1 << 61, timedelta(days=21)
    begin, end = datetime(first_year, 1, 1, tzinfo=timezone.utc), datetime(last_year, 1, 1, tzinfo=timezone.utc)
    out = []
    names: dict[str, int] = {}
    clocks: dict[bytes, int] = {}
    seen: set[int] = set()
    for name in sorted(zoneinfo.available_timezones()):
        rules = _rules(name)
        names[name] = clocks.setdefault(rules, len(clocks))
        if names[name] in seen:
            continue
        seen.add(names[name])
        clock, zone = names[name], zoneinfo.ZoneInfo(name)
        changes: list[tuple[int, int, int]] = []  # instant, offset before, after
        start_off = begin.astimezone(zone).utcoffset()
        for second, before, after in _listed(rules):
            if begin.timestamp() < second < end.timestamp():
                changes.append((second * 1_000_000, before * 1_000_000, after * 1_000_000))
        # The rule that goes on after the listed changes is followed step by step, if there is one.
        t = max(begin, _EPOCH + timedelta(microseconds=changes[-1][0])) if changes else begin
        if rules[:4] == b"TZif" and b"," not in rules.rstrip(b"\n").rsplit(b"\n", 1)[-1]:
            t = end
        off = t.astimezone(zone).utcoffset()
        while t < end:
            u = min(t + step, end)
            if (o := u.astimezone(zone).utcoffset()) != off:
                lo, hi = t, u
                while hi - lo > timedelta(seconds=1):
                    mid = lo + timedelta(seconds=(hi - lo) // timedelta(seconds=2))
                    lo, hi = (mid, hi) if mid.astimezone(zone).utcoffset() == off else (lo, mid)
                changes.append(((hi - _EPOCH) // timedelta(microseconds=1), off // timedelta(microseconds=1), o // timedelta(microseconds=1)))
                off = o
            t = u
        at = -far
        for instant, before, after in changes:
            a, b = sorted((instant + before, instant + after))
            kind = "none" if after > before else "two"
            out += [(clock, at, a, before, "one"), (clock, a, b, before, kind)]
            at = b
        out.append((clock, at, far, changes[-1][2] if changes else start_off // timedelta(microseconds=1), "one"))
    by_year = []
    starts = {y: (datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH) // timedelta(microseconds=1) for y in range(first_year, last_year + 2)}
    for clock, a, b, off, kind in out:
        y0 = first_year if a < starts[first_year] else min(last_year, (_EPOCH + timedelta(microseconds=a)).year)
        y1 = last_year if b > starts[last_year] else max(first_year, (_EPOCH + timedelta(microseconds=b - 1)).year)
        by_year += [(clock, y, a, b, off, kind) for y in range(y0, y1 + 1)]
    return names, by_year


def zone_tables(spark: SparkSession, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> tuple[DataFrame, DataFrame]:
    """(zone, zone_clock) of all zones, and the segments of their clocks."""
    names, rows = zone_segments(first_year, last_year)
    cols = ["clock_no", "zone_year", "local_from", "local_to", "zone_offset", "clock"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    segments = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=cols)
    zones = pa.table([pa.array(list(names)), pa.array(list(names.values()), pa.int32())], names=["zone_name", "zone_clock"])
    return spark.createDataFrame(zones), spark.createDataFrame(segments)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _offset_us(z: Column) -> Column:
    """Microseconds of an offset (`+02`, `-0330`, `+09:00`) or a known abbreviation; null for none or unknown."""
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    num = F.regexp_replace(F.regexp_replace(z, r"^(?:UTC|GMT)|:", ""), "\u2212", "-")
    minutes = _int(F.substring(num, 2, 2)) * 60 + F.coalesce(_int(F.substring(num, 4, 2)), F.lit(0))
    signed = F.when(num.startswith("-"), -minutes).otherwise(minutes)
    return F.when(num.rlike(r"^[+-]"), signed).otherwise(F.try_element_at(known, F.upper(z))).cast("long") * 60_000_000


def parse(df: DataFrame, text: Column, zone: Column, month_first: Column) -> DataFrame:
    """df with _form, _local (µs on the local clock), _offset (µs), _zone (name) and _utc (bare numbers); all null if no time."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    bracket = F.regexp_extract(trimmed, r"\[([A-Za-z0-9_+\-/]+)\]\z", 1)
    base = F.when(bracket != "", F.regexp_replace(trimmed, r"\s*\[[A-Za-z0-9_+\-/]+\]\z", "")).otherwise(trimmed)
    form = F.when(F.col("_base").rlike(r"\A\d{1,19}(?:\.\d+)?\z"), "number")
    parts = None
    for name, pattern, repl in FORMS:
        hit = F.col("_base").rlike(pattern)
        form = form.when(hit, name)
        line = F.regexp_replace("_base", pattern, repl)
        parts = F.when(F.col("_form") == name, line) if parts is None else parts.when(F.col("_form") == name, line)
    d = df.withColumns({"_base": base, "_bracket": bracket}).withColumn("_form", form).withColumn("_p", F.split(parts, r"\|"))
    p = [F.col("_p")[i] for i in range(9)]
    slashed, month_first = F.col("_form") == "slashed", F.coalesce(month_first, F.lit(False))
    named = F.lower(F.substring(p[1], 1, 3))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS) for x in (m, i + 1)]), named)
    month = F.when(F.col("_form").isin("named", "mail"), by_name).when(slashed & ~month_first, _int(p[2])).otherwise(_int(p[1]))
    day = F.when(slashed & ~month_first, _int(p[1])).otherwise(_int(p[2]))
    half = F.lower(p[7])
    h = F.coalesce(_int(p[3]), F.lit(0))
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second = F.coalesce(_int(p[4]), F.lit(0)), F.coalesce(_int(p[5]), F.lit(0))
    micros = F.coalesce(F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("long"), F.lit(0))
    date = F.try_make_timestamp_ntz(_int(p[0]), month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    valid = (hour < 24) & (minute < 60) & (second < 60)
    local = F.when(valid, F.unix_date(date).cast("long") * _DAY_US + ((hour * 60 + minute) * 60 + second).cast("long") * 1_000_000 + micros)
    whole, frac = F.substring_index("_base", ".", 1), F.regexp_extract("_base", r"\.(\d+)$", 1)
    n, size = whole.try_cast("long"), F.length(whole)
    number = (
        F.when(size <= 11, n * 1_000_000 + F.coalesce(F.rpad(F.substring(frac, 1, 6), 6, "0").try_cast("long"), F.lit(0)))
        .when(size <= 14, n * 1000 + F.coalesce(F.rpad(F.substring(frac, 1, 3), 3, "0").try_cast("long"), F.lit(0)))
        .when(size <= 17, n)
        .when(size == 18, F.floor((n - _TICKS_1970) / F.lit(10).cast("decimal(2,0)")).cast("long"))
        .otherwise(F.floor(n / F.lit(1000).cast("decimal(4,0)")).cast("long"))
    )
    has_zone = p[8] != ""
    offset = F.when(has_zone, _offset_us(p[8]))
    # An abbreviation that no offset is known for names no instant.
    d = d.withColumns({"_local": F.when(~has_zone | offset.isNotNull(), local), "_offset": offset, "_utc": F.when(F.col("_form") == "number", number)})
    return d.withColumn("_zone", F.when(F.col("_bracket") != "", F.col("_bracket")).otherwise(zone)).drop("_base", "_bracket", "_p")


def normalise(df: DataFrame, text_col: str, zone_col: str, month_first_col: str | None = None, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """df with utc_us (microseconds since 1970 UTC, finer digits dropped), time_form, time_clock and time_exact.

    Text without a zone is read on the clock of zone_col, or of a zone name in brackets; local times that occur twice or not at
    all take the offset in force before the change, and time_clock says `two` or `none` (else `one`; null where no clock was
    asked). Bare numbers count from 1970 in s, ms, µs or ns by their length, or are Windows ticks (18 digits). A date alone is
    its first instant. utc_us is null for null and blank texts, impossible dates, words, and local texts whose zone is
    null or unknown. time_exact marks texts already in the form YYYY-MM-DDTHH:MM:SS[.f]Z. Names must not clash with these
    four, those beginning with an underscore and the columns of `zone_tables`; all other columns are kept.

    The zone tables are fixed ones and are broadcast; rows aren't shuffled.
    """
    month_first = F.col(month_first_col) if month_first_col else F.lit(False)
    d = parse(df, F.col(text_col), F.col(zone_col), month_first)
    asks = F.col("_local").isNotNull() & F.col("_offset").isNull()
    year = F.greatest(F.lit(first_year), F.least(F.lit(last_year), F.year(F.timestamp_micros(F.greatest(F.lit(-10**17), F.least(F.lit(10**17), F.col("_local")))))))
    d = d.withColumns({"_asks": F.when(asks, F.col("_zone")), "_year": F.when(asks, year).cast("int")})
    zones, segments = zone_tables(df.sparkSession, first_year, last_year)
    d = d.join(F.broadcast(zones), F.col("_asks") == F.col("zone_name"), "left")
    on = (F.col("zone_clock") == F.col("clock_no")) & (F.col("_year") == F.col("zone_year")) & (F.col("_local") >= F.col("local_from")) & (F.col("_local") < F.col("local_to"))
    j = d.join(F.broadcast(segments), on, "left")
    return j.select(
        *[df[c] for c in df.columns],
        F.coalesce("_utc", F.col("_local") - F.coalesce("_offset", "zone_offset")).alias("utc_us"),
        F.col("_form").alias("time_form"),
        F.col("clock").alias("time_clock"),
        F.coalesce(F.col(text_col).rlike(EXACT), F.lit(False)).alias("time_exact"),
    )


def times_found(rows: DataFrame, known: DataFrame, clients: DataFrame) -> DataFrame:
    """p4_found: (table_name, row_id, utc_us) of the texts that name an instant and aren't exact already."""
    host = clients.select(F.col("client_id").alias("cid"), F.col("time_zone").alias("tz"), (F.col("locale") == "en-US").alias("mf"))
    # Rows delivered twice are one record. They are made one after the filter, on the few columns left.
    a = rows.select(F.lit("component_rows").alias("table_name"), F.col("row_id"), F.col("when_text").alias("text"), "client_id").where(~F.col("text").rlike(EXACT))
    a = a.join(host, a["client_id"] == host["cid"], "left").select("table_name", "row_id", "text", "tz", "mf")
    b = known.select(F.lit("autoruns_known_good").alias("table_name"), F.col("record_id").alias("row_id"), F.col("modified_time").alias("text"), F.col("origin_zone").alias("tz"), F.lit(False).alias("mf")).where(~F.col("text").rlike(EXACT))
    n = normalise(a.unionByName(b), "text", "tz", "mf")
    return n.where("utc_us is not null and not time_exact").select("table_name", "row_id", "utc_us").distinct()
