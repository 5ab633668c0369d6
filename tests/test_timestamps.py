from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lodestar.operators import timestamps as T

UTC = timezone.utc


def us(*a, zone=None, fold=0, micro=0):
    d = datetime(*a, fold=fold, tzinfo=ZoneInfo(zone) if zone else UTC)
    return (d.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1) + micro


CASES = [
    ("2025-03-21T19:40:52.675Z", "Asia/Tokyo", False, us(2025, 3, 21, 19, 40, 52, micro=675000)),
    (" 2025-03-21T19:40:52Z ", "Asia/Tokyo", False, us(2025, 3, 21, 19, 40, 52)),
    ("2025-04-01t19:13:59.661+09", "UTC", False, us(2025, 4, 1, 10, 13, 59, micro=661000)),
    ("2025-10-18 11:51:53.575576599 -03:30", "UTC", False, us(2025, 10, 18, 15, 21, 53, micro=575576)),
    ("2026-07-16 03:03:16 EDT", "UTC", False, us(2026, 7, 16, 7, 3, 16)),
    ("20250420T232816", "Europe/Berlin", False, us(2025, 4, 20, 21, 28, 16)),
    ("20250830T014706[Australia/Sydney]", "UTC", False, us(2025, 8, 30, 1, 47, 6, zone="Australia/Sydney")),
    ("18.10.2025 13:51:52 [Asia/Kolkata]", "UTC", False, us(2025, 10, 18, 8, 21, 52)),
    ("03/02/2026 15:18:55", "UTC", False, us(2026, 2, 3, 15, 18, 55)),
    ("7/16/2026 12:42:41 AM", "America/New_York", True, us(2026, 7, 16, 4, 42, 41)),
    ("Oct 5, 2025 7:05:15 PM", "UTC", False, us(2025, 10, 5, 19, 5, 15)),
    ("Sun, 26 Oct 2025 02:19:03 +0100", "UTC", False, us(2025, 10, 26, 1, 19, 3)),
    ("2025-03-08", "America/Los_Angeles", False, us(2025, 3, 8, 8)),
    ("25.03.2026", "Europe/Berlin", False, us(2026, 3, 24, 23)),
    ("1763686559", "Asia/Tokyo", False, 1763686559_000000),
    ("1763687430.921", "Asia/Tokyo", False, 1763687430_921000),
    ("1768411918700", "Asia/Tokyo", False, 1768411918_700000),
    ("1763687397975187", "Asia/Tokyo", False, 1763687397975187),
    ("1761235507182764320", "Asia/Tokyo", False, 1761235507182764),
    ("134052619128460927", "Asia/Tokyo", False, (134052619128460927 - 116444736000000000) // 10),
    # Clock changes: the offset in force before the change.
    ("2025-10-26T02:30:00", "Europe/Berlin", False, us(2025, 10, 26, 0, 30)),
    ("2025-03-30T02:30:00", "Europe/Berlin", False, us(2025, 3, 30, 1, 30)),
    ("2025-11-02 01:15:00", "America/New_York", True, us(2025, 11, 2, 5, 15)),
    ("2018-11-04", "America/Sao_Paulo", False, us(2018, 11, 4, 3)),
    # No instants.
    ("2025-02-30T10:11:12+01:00", "UTC", False, None),
    ("2025-13-04 08:00:00", "UTC", False, None),
    ("25:61:07", "UTC", False, None),
    ("unknown", "UTC", False, None),
    ("2025-01-01 10:00:00 XYZ", "UTC", False, None),
    ("2025-01-01 10:00:00", "Mars/Base", False, None),
    ("2025-01-01 10:00:00", None, False, None),
    ("", "UTC", False, None),
    ("   ", "UTC", False, None),
    (None, "UTC", False, None),
    ("9" * 5000, "UTC", False, None),
]


@pytest.fixture(scope="module")
def done(spark):
    # A column `zone` of the caller's own and repeated rows don't disturb.
    rows = [(i, t, z, m, "mine") for i, (t, z, m, _) in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "id int, text string, tz string, mf boolean, note string")
    return T.normalise(df, "text", "tz", "mf").collect()


def test_instants(done):
    assert len(done) == 2 * len(CASES)
    assert {(r.id, r.utc_us) for r in done} == {(i, c[3]) for i, c in enumerate(CASES)}


def test_clock_and_exactness(done):
    by = {CASES[r.id][0]: r for r in done}
    assert by["2025-10-26T02:30:00"].time_clock == "two"
    assert by["2025-03-30T02:30:00"].time_clock == "none"
    assert by["20250420T232816"].time_clock == "one"
    assert by["2025-03-21T19:40:52.675Z"].time_exact and not by[" 2025-03-21T19:40:52Z "].time_exact


def test_segments_agree_with_zoneinfo():
    names, rows = T.zone_segments()
    by = {}
    for clock, _, a, b, off, kind in rows:
        by.setdefault(clock, set()).add((a, b, off, kind))
    for zone in ("Europe/Berlin", "Asia/Kolkata", "Africa/Casablanca", "Australia/Lord_Howe"):
        segs = sorted(by[names[zone]])
        assert all(x[1] == y[0] for x, y in zip(segs, segs[1:], strict=False))
        t = datetime(1905, 1, 1)
        while t < datetime(2095, 1, 1):
            local = (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            seg = next(s for s in segs if s[0] <= local < s[1])
            assert seg[2] == t.replace(tzinfo=ZoneInfo(zone)).utcoffset() // timedelta(microseconds=1) or seg[3] == "none"
            t += timedelta(hours=1977)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string, tz string")
    out = T.normalise(df, "text", "tz")
    assert out.count() == 0 and "utc_us" in out.columns


def test_found_skips_exact(spark):
    rows = spark.createDataFrame([(1, "c", "2025-01-01T00:00:00Z"), (2, "c", "2025-01-01T09:00:00"), (2, "c", "2025-01-01T09:00:00"), (3, "x", "1763686559")], "row_id long, client_id string, when_text string")
    known = spark.createDataFrame([(7, "01.02.2025", "UTC")], "record_id long, modified_time string, origin_zone string")
    clients = spark.createDataFrame([("c", "Asia/Tokyo", "en-GB")], "client_id string, time_zone string, locale string")
    got = sorted(tuple(r) for r in T.times_found(rows, known, clients).collect())
    assert got == [("autoruns_known_good", 7, us(2025, 2, 1)), ("component_rows", 2, us(2025, 1, 1)), ("component_rows", 3, 1763686559_000000)]
    assert T.times_found(rows.where(F.lit(False)), known.where(F.lit(False)), clients).count() == 0
