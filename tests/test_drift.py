import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.operators import drift as D

RAW = "file_id long, request_id string, component_name string, schema_version string, exported_at timestamp, line_no int, record_json string"
CONTRACT = [(1, "A", "user", "User"), (1, "A", "user", "AccountName"), (1, "A", "pid", "Pid"), (1, "A", "score", "Score"), (1, "A", "tags", "Tags"), (1, "A", "hash", "Sha1")]


def rows(*files):
    out = []
    for i, recs in enumerate(files, 1):
        for n, r in enumerate(recs, 1):
            out.append((i, "r", "c", None, datetime(2025, 1, i), n, r if isinstance(r, str) or r is None else json.dumps(r)))
    return out


@pytest.fixture(scope="module")
def contract(spark):
    return spark.createDataFrame(CONTRACT, "schema_version int, artifact string, semantic string, alias_name string")


def found(spark, contract, *files):
    return sorted(tuple(r) for r in D.drift_found(spark.createDataFrame(rows(*files), RAW), contract).collect())


def test_all_kinds(spark, contract):
    got = found(
        spark,
        contract,
        [{"User": "a", "Pid": 5, "Extra": 1}, {"User": None, "Pid": 6}],
        [{"AccountName": "a", "Pid": "5", "Score": 1.5}],
        [{"AccountName": ["a"], "Pid": "6", "Score": None}],
        [{"AccountName": ["b"], "Pid": "6", "Score": 2.5, "process_id": 3}],
    )
    assert got == [
        (2, "Extra", "removed", ""),
        (2, "Pid", "retyped", ""),
        (2, "Score", "added", ""),
        (2, "User", "renamed", "AccountName"),
        (3, "AccountName", "retyped", ""),
        (4, "process_id", "added", ""),
    ]


def test_names_by_spelling_and_values(spark, contract):
    h = [f"{i:040x}" for i in range(1, 30)]
    got = found(spark, contract, [{"Sha1": x} for x in h], [{"Digest": x} for x in h], [{"digest_": x} for x in h])
    assert (2, "Sha1", "renamed", "Digest") in got and (3, "Digest", "renamed", "digest_") in got


def test_series_follow_export_time_not_id(spark, contract):
    r = [(9, "r", "c", None, datetime(2025, 1, 1), 1, '{"User":"a"}'), (3, "r", "c", None, datetime(2025, 1, 2), 1, '{"User":"a","Pid":1}'), (3, "r", "c", None, datetime(2025, 1, 2), 1, '{"User":"a","Pid":1}')]
    got = [tuple(x) for x in D.drift_found(spark.createDataFrame(r, RAW), contract).collect()]
    assert got == [(3, "Pid", "added", "")]


def test_broken_null_and_empty_records(spark, contract):
    assert found(spark, contract, [{"User": "a"}, None, "no json", "[1]"], [{"User": "b"}, ""]) == []
    assert D.drift_found(spark.createDataFrame([], RAW), contract).count() == 0


def test_one_table_with_rescue(spark, contract):
    raw = spark.createDataFrame(rows([{"User": "a", "Pid": "17", "Other": {"x": 1}, "Score": "high"}, {"AccountName": ["b"], "Pid": 18, "Tags": ["p", "q"]}]), RAW)
    got = {r.line_no: r for r in D.ingest(raw.withColumn("kinds", raw.file_id), contract).collect()}
    assert (got[1].user, got[1].pid, got[1].score) == ("a", 17, None)
    assert {k: json.loads(v.json) for k, v in got[1].rescued.items()} == {"Other": {"x": 1}, "Score": "high"}
    assert (got[2].user, got[2].pid, got[2].tags) == ("b", 18, ["p", "q"]) and got[2].rescued == {}
    assert {m: tuple(v) for m, v in got[1].typed.items()} == {"user": ("User", "string"), "pid": ("Pid", "string")}


def test_numbers_by_their_text(spark, contract):
    got = found(spark, contract, ['{"Score": 9, "Pid": 12345678901234567890, "B": 1e2}'], ['{"Score": 9.0, "Pid": 5, "B": 100}'])
    assert got == [(2, "B", "retyped", ""), (2, "Score", "retyped", "")]


def test_long_values(spark, contract):
    got = found(spark, contract, [{"User": "x" * 200_000}], [{"User": 7}])
    assert got == [(2, "User", "retyped", "")]


def test_replay_fills_columns_of_an_earlier_table(spark, contract):
    raw = spark.createDataFrame(rows([{"User": "a", "Owner": "b"}, {"User": None, "Owner": "c", "Nr": 7, "Other": 1}, {"Nr": "no number"}, None, {"A_User": "d", "User": "e"}]), RAW)
    names = spark.createDataFrame([("User", "user", "contract")], "name string, semantic string, how string")
    early = D.ingest(raw, contract, names)
    assert [(r.user, r.pid) for r in early.orderBy("line_no").collect()] == [("a", None), (None, None), (None, None), (None, None), ("e", None)]
    later = spark.createDataFrame([("Owner", "user", "values"), ("Nr", "pid", "values"), ("A_User", "user", "values")], names.schema)
    got = D.replay(early, later, D.target(contract)).orderBy("line_no").collect()
    assert [(r.user, r.pid) for r in got] == [("a", None), ("c", 7), (None, None), (None, None), ("e", None)]
    assert [r.rescued and {k: v.json for k, v in r.rescued.items()} for r in got] == [{"Owner": '"b"'}, {"Other": "1"}, {"Nr": '"no number"'}, None, {"A_User": '"d"'}]
    assert got[1].nulls == ["User"] and got[3].typed is None
    assert D.ingest(raw, contract, names.union(later)).orderBy("line_no").collect() == got


def test_more_names_than_the_plan_holds(spark, contract, monkeypatch):
    raw = spark.createDataFrame(rows([{"User": "a", "Pid": 5, "Other": 1}, {"zzz": "c", "yyy": 7}, None, {}, {"zzz": "d", "Pid": None}]), RAW)
    names = spark.createDataFrame([("Pid", "pid", "contract"), ("User", "user", "contract"), ("yyy", "pid", "values"), ("zzz", "user", "values")], "name string, semantic string, how string")
    want = D.ingest(raw, contract, names).orderBy("line_no").collect()
    assert [(r.user, r.pid) for r in want] == [("a", 5), ("c", 7), (None, None), (None, None), ("d", None)]
    monkeypatch.setattr(D, "LITERAL_NAMES", 1)
    assert D.ingest(raw, contract, names).orderBy("line_no").collect() == want


def test_columns_follow_the_contract(spark):
    contract = spark.createDataFrame([(1, "A", "owner", "Owner"), (1, "A", "pid", "Pid"), (1, "A", None, "X")], "schema_version int, artifact string, semantic string, alias_name string")
    got = D.ingest(spark.createDataFrame(rows([{"Owner": "a", "Pid": [7], "X": 1.50}]), RAW), contract)
    assert {c: t for c, t in got.dtypes if c in ("owner", "pid", "user")} == {"owner": "string", "pid": "bigint"}
    assert [(r.owner, r.pid, list(r.rescued)) for r in got.collect()] == [("a", 7, ["X"])]


def test_report_is_made_from_the_table(spark, contract):
    raw = spark.createDataFrame(rows([{"User": "a", "Pid": "x"}], [{"AccountName": "b", "Pid": 3, "New": None}]), RAW)
    names = D.approvals(D.read_fields(raw), contract)
    table = D.ingest(raw, contract, names)
    lost = table.withColumn("rescued", F.map_filter("rescued", lambda k, _: F.lit(False)))
    whole = {tuple(r) for r in D.changes(table, names).collect()}
    assert whole == {(2, "User", "renamed", "AccountName"), (2, "Pid", "retyped", ""), (2, "New", "added", "")}
    assert {tuple(r) for r in D.changes(lost, names).collect()} == {(2, "User", "renamed", "AccountName"), (2, "Pid", "added", ""), (2, "New", "added", "")}
