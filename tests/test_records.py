import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import hashing
from lodestar.operators import findings, golden, numbering, predicates
from lodestar.operators import records as R
from lodestar.sources import readers, sinks


def test_search_gives_places_and_context(spark):
    text = 'run C:\\Tools\\a.exe "quiet"\nand A.EXE again'
    df = spark.createDataFrame([(1, text, None), (2, None, ""), (3, "", "x" * 100_000 + "a.exe")], "id long, a string, b string")
    got = sorted(tuple(r) for r in R.search(df, "id", ["a", "b"], ["a.exe"], [r"q\w+", "z*"], 4).collect())
    want = []
    for i, field, v in ((1, "a", text), (3, "b", "x" * 100_000 + "a.exe")):
        at = v.lower().find("a.exe")
        while at >= 0:
            want.append((i, field, "literal", "a.exe", at, at + 5, v[at : at + 5], v[max(0, at - 4) : at], v[at + 5 : at + 9]))
            at = v.lower().find("a.exe", at + 5)
    q = text.find("quiet")
    want.append((1, "a", "regex", r"q\w+", q, q + 5, "quiet", text[q - 4 : q], text[q + 5 : q + 9]))
    assert got == sorted(want)
    assert R.search(df, "id", ["a"], ["A.EXE"], case_sensitive=True).count() == 1


def test_rows_hold_paths_and_quotes(spark):
    df = spark.createDataFrame([(1, "C:\\Users\\Bob", ["x"], {"k": "v"}), (2, 'say "hi"', None, None), (3, None, ["D:\\a\"b"], {"p": "c:\\users\\bob\\z"})], "id long, a string, b array<string>, c map<string,string>")
    find = lambda x: {r.id for r in df.where(predicates.anywhere(df, x)).collect()}
    assert find("users\\BOB") == {1, 3} and find('"HI"') == {2} and find('a"b') == {3} and find("nothing") == set()


def test_long_numbers_sort_as_numbers(spark):
    names = ["F9", "F10", "f" + "9" * 26, "F1" + "0" * 29, "F007", "G1", ""]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(findings.natural_key(F.col("n"))).collect()]
    assert got == ["", "F007", "F9", "F10", "f" + "9" * 26, "F1" + "0" * 29, "G1"]


def test_identities_ignore_spelling_and_nulls(spark):
    cols = "id long, image_path string, launch_string string, signer string"
    rows = spark.createDataFrame([(1, "C:\\Users\\Alice\\app.exe", None, None), (2, "C:\\Other\\app.exe", None, None), (3, "%windir%\\x.sys", "a&b", "S")], cols)
    known = spark.createDataFrame([(9, "%USERPROFILE%\\app.exe", None, None), (8, "c:\\WINDOWS\\x.sys", "A&B", "s")], cols)
    keys = ["image_path", "launch_string", "signer"]
    assert [r.id for r in golden.subtract_identities(rows, known, keys).collect()] == [2]
    assert {r.id for r in golden.select_identities(rows, known, keys).collect()} == {1, 3}
    assert [r.id for r in golden.delete_by_key(rows, rows.where("id = 2"), ["launch_string", "signer"]).collect()] == [3]


@pytest.mark.parametrize("value", ['a"b\\c', "<&>\u2028\t\x01", "plain", ""])
def test_json_strings(spark, value):
    got = spark.createDataFrame([(value,)], "v string").select(hashing.json_string(F.col("v"))).first()[0]
    assert json.loads(got) == value and not set("<>&\u2028") & set(got)


def test_places_within_hot_keys(spark):
    rows = [("hot" if i % 3 else None if i % 2 else "k", i) for i in range(3000)]
    got = numbering.numbered_within(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], ["v"]).collect()
    want = {}
    for k, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, []).append(v)
    assert len(got) == 3000 and all(want[r.k][r.n - 1] == r.v for r in got)


@pytest.mark.parametrize("total", [0, 7, 23, 1000])
def test_shares_as_given_out_round_by_round(spark, total):
    demand = {"a": 5, "b": 0, "c": 9, "d": 2, "e": 9, "f": None, "g": -3}
    want, left = dict.fromkeys(demand, 0), min(total, 25)
    while left:
        open_ = [k for k in sorted(demand) if want[k] < (demand[k] or 0)]
        each = max(1, left // len(open_))
        for k in open_:
            give = min(each, demand[k] - want[k], left)
            want[k], left = want[k] + give, left - give
    got = R.fair_shares(spark.createDataFrame(list(demand.items()), "k string, d long"), "k", "d", total).collect()
    assert {r.k: r.share for r in got} == want


def test_preamble_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1, ["x"]), ('q"q', None, None), ("two\nlines", 3, [])], "name string, n int, tags array<string>").repartition(2)
    sinks.write_csv_with_preamble(df, str(tmp_path / "out"), {"host": "ws-1", "made": "to day"})
    back = readers.csv_with_preamble(spark, str(tmp_path / "out"))
    assert back.columns == ["name", "n", "tags"]
    assert sorted(tuple(r) for r in back.collect()) == [("a, b", "1", '["x"]'), ('q"q', None, None), ("two lines", "3", "[]")]
    assert {tuple(r) for r in readers.metadata_of(spark, str(tmp_path / "out")).collect()} == {("host", "ws-1"), ("made", "to day")}


def test_pages_hold_their_bytes(spark):
    df = spark.createDataFrame([(i, "a", "é" * 50) for i in range(10)] + [(99, "b", "x")], "id long, kind string, text string")
    got = R.page(df, ["id"], {"kind": "a"}, 2, 200, "text", 350, 40).orderBy("id").collect()
    assert [(r.id, len(r.text), r.clipped, r.matching, r.next_offset) for r in got] == [(i, 40, True, 10, 6) for i in (2, 3, 4, 5)]
    assert R.page(df, ["id"], {"kind": "b"}, 0, 1, "text", 0).collect()[0].next_offset is None
