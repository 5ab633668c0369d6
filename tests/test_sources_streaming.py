import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestar.sources import readers, sinks
from lodestar.streaming import stream


def test_csv_with_preamble(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('\ufeff# made: today\n\n# host: x\nName,Note\nfoo,"a, b"\nbar,\n', encoding="utf-8")
    got = [tuple(r) for r in readers.csv_with_preamble(spark, str(p)).collect()]
    assert got == [("foo", "a, b"), ("bar", None)]
    assert sorted(tuple(r) for r in readers.metadata_of(spark, str(p)).collect()) == [("host", "x"), ("made", "today")]
    q = tmp_path / "b.csv"
    q.write_text("A,A\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.csv_with_preamble(spark, str(q))


def test_repeated_keys(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":1,"c":2}}',), ('{"a":1}',), ("nope",), (None,)], "t string")
    assert [r[0] for r in df.select(readers.repeated_keys(F.col("t"))).collect()] == [True, False, None, None]


def test_json_rows(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"rows": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "2.json").write_text('[{"a": 3}]')
    (tmp_path / "3.json").write_text('{"a": 4}\n\nbroken\n{"a": 5}\n')
    got = readers.json_rows(spark, str(tmp_path)).select(F.variant_get("value", "$.a", "int").alias("a"))
    assert sorted(r.a for r in got.collect()) == [1, 2, 3, 4, 5]
    assert [r.value for r in readers.broken_lines(spark, str(tmp_path / "3.json")).collect()] == ["broken"]


def test_csv_chunks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n"{""k"": [2]}","3 apples"\n')
    got = readers.csv_chunks(spark, str(tmp_path)).orderBy("line").select("file", "line", F.to_json("row").alias("j")).collect()
    assert [(r.file, r.line, json.loads(r.j)) for r in got] == [("c.csv", 2, {"a": 1, "b": "x\ny"}), ("c.csv", 4, {"a": {"k": [2]}, "b": "3 apples"})]


def test_uploads_index(spark, tmp_path):
    rows = [{"_Components": ["C", "A.txt"], "file_size": 5, "uploaded_size": 5}, {"_Components": ["c", "a.TXT"], "file_size": 6, "uploaded_size": 1}, {"_Components": [], "file_size": 1, "uploaded_size": 1}, {"_Components": ["x"], "file_size": -1, "uploaded_size": 1}]
    (tmp_path / "u.json").write_text("\n".join(map(json.dumps, rows)))
    assert [tuple(r) for r in readers.uploads_index(spark, str(tmp_path)).collect()] == [("C/A.txt", 5, 5, True)]


def test_log_lines(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text('2025-01-01T00:00:00Z INFO [op-1] stage done | rows=5 who="a b"\nnoise\n')
    r = readers.log_lines(spark, str(p), ["rows", "who", "none"]).collect()
    assert [tuple(x) for x in r] == [("2025-01-01T00:00:00Z", "INFO", "op-1", "stage done", "5", "a b", None)]


def test_sqlite(spark, tmp_path):
    p = tmp_path / "r.sqlite"
    with sqlite3.connect(p) as db:
        db.execute("create table known (hash_key text, description text)")
        db.execute("insert into known values ('ab', null)")
    assert [tuple(r) for r in readers.sqlite_table(spark, str(p), "known").collect()] == [("ab", None)]
    with pytest.raises(ValueError, match="no table"):
        readers.sqlite_table(spark, str(p), "other")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, ["x"], None), ("s", 2, ["y"], "é"), ("t", 1, [], "z")], "src string, n int, l array<string>, v string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    sinks.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == df.columns and json.loads(back.where("n = 2").first().l) == ["y"]
    sinks.write_lines(df, "v", str(tmp_path / "t"))
    chunks = sinks.content_chunks(df, "src", ["n"], 24).collect()
    assert sum(c.n for c in chunks) == 3 and all(len(c.csv) <= 24 or c.n == 1 for c in chunks)
    again = sinks.content_chunks(df.repartition(3), "src", ["n"], 24)
    assert {c.sha256 for c in again.collect()} == {c.sha256 for c in chunks}
    assert sinks.merge_chunks([again, again]).count() == len({c.sha256 for c in chunks})


def test_streams(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    folder = tmp_path / "in"
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(folder))
    batch = spark.read.parquet(str(folder))
    s = stream.read_stream(spark, str(folder), schema, "ts")
    run = stream.drain(stream.running_stack(s, ["event_type"]), "run_stack", "complete")
    assert {tuple(r) for r in run.collect()} == {tuple(r) for r in batch.groupBy("event_type").count().collect()}
    # In one batch no row is late; rows later than the watermark are left to the next run's overlap.
    whole = stream.read_stream(spark, str(folder), schema, "ts", files_per_batch=100)
    uniq = stream.drain(stream.once_within(whole.union(whole), ["event_id"], "ts"), "uniq")
    assert uniq.count() == batch.select("event_id").distinct().count()
    hit = stream.first_match(s, F.col("event_id") % 7 == 3, str(tmp_path / "ck"), ["event_id"])
    assert hit.count() == 1 and hit.first().event_id % 7 == 3
    assert stream.first_match(s, F.lit(False), str(tmp_path / "ck2"), ["event_id"]) is None
    q = stream.upsert_batches(s, "user_id", F.col("ts"), str(tmp_path / "out"), str(tmp_path / "ck3"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("user_id").distinct().count() == batch.select("user_id").distinct().count()
    ts = F.col("ts").cast("timestamp")
    lo, hi = batch.agg(F.min(ts), F.max(ts)).first()
    assert stream.since_cursor(batch, ts, F.lit(lo), F.lit(hi)).count() == batch.count()


def test_first_match_of_all_batches(spark, tmp_path):
    for ids in ([5, 8], [3, 9], [4]):
        spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stream.read_stream(spark, str(tmp_path / "in"), "event_id long")
    assert stream.first_match(s, F.col("event_id") > 0, str(tmp_path / "ck"), ["event_id"]).first().event_id == 3
    with pytest.raises(TimeoutError):
        stream.first_match(s, F.col("event_id") > 0, str(tmp_path / "ck2"), ["event_id"], timeout_s=0.001)


def test_late_rows_of_many_batches_are_kept_once(spark, tmp_path):
    for rows in ([(1, "2025-01-02 00:00:00"), (2, "2025-01-02 01:00:00")], [(3, "2025-01-01 00:00:00"), (1, "2025-01-02 00:00:00"), (None, None)], [(4, "2024-01-01 00:00:00"), (None, None)]):
        spark.createDataFrame(rows, "event_id long, ts string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    s = stream.read_stream(spark, str(tmp_path / "events.parquet"), "event_id long, ts string", "ts")
    got = stream.once_to_table(s.select("event_id"), ["event_id"], str(tmp_path / "run")).collect()
    assert sorted(r.event_id or 0 for r in got) == [0, 1, 2, 3, 4]
