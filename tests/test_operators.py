import pytest
from pyspark.sql import functions as F

from lodestar.functions import hashing, text
from lodestar.operators import evidence as E
from lodestar.operators import findings as D
from lodestar.operators import golden as G
from lodestar.operators import predicates as P
from lodestar.operators import stacks as S
from lodestar.operators.numbering import numbered

UNICODE = ["Straße", "STRASSE", "CAFÉ", "café", "é", "e\u0301", "İ", "i", "日本語😀", "<&>\u2028", '"\\\n\t\x01', "", " ", None]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_paths(spark):
    same = [r"C:\Users\Alice\app.exe", r"%USERPROFILE%\app.exe", r"c:\documents and settings\bob\APP.exe"]
    assert {one(spark, p, text.identity_path) for p in same} == {r"c:\users\user\app.exe"}
    assert one(spark, "\\SystemRoot\\a", text.identity_path) == "c:\\windows\\a"
    assert one(spark, r"%windir%\$x", text.identity_path) == r"c:\windows\$x"
    assert one(spark, None, text.identity_path) == ""


def test_identity_needs_letters_exactly(spark):
    import hashlib
    import json

    def want(v):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v or "")
        t = json.dumps({"ImagePath": low, "LaunchString": "", "Signer": low}, indent=1, ensure_ascii=False)
        for ch in "&<>\u2028\u2029":
            t = t.replace(ch, f"\\u{ord(ch):04x}")
        return hashlib.sha1(t.encode()).hexdigest()

    df = spark.createDataFrame([(v,) for v in UNICODE], "v string")
    got = df.select("v", hashing.identity_key(F.col("v"), F.lit(None).cast("string"), F.col("v")).alias("h")).collect()
    assert [(r.v, r.h) for r in got] == [(v, want(v)) for v in UNICODE]


def test_small_text_functions(spark):
    assert one(spark, "a" * 30, lambda c: text.truncated(c, 10)) == "aaaaaaa..."
    assert one(spark, "  Foo -- Bär!", text.slug) == "foo-b-r"
    assert one(spark, '["b","a","a"]', text.labels) == ["a", "b"] and one(spark, "b, a,,", text.labels) == ["a", "b"]
    assert one(spark, r"x\y.sys", lambda c: text.glob_match(c, "*.sys")) and not one(spark, " ", lambda c: text.glob_match(c, "*"))
    v = one(spark, "a\x00\tb   c" + " " * 9, lambda c: text.context_value(c, 4))
    assert v == "a b" and one(spark, v, lambda c: text.context_value(c, 4)) == v


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, True), (3, "", False)], "i int, d string, b boolean")
    assert [r.i for r in df.where(P.dimension_equals(F.col("d"), "")).collect()] == [2, 3]
    assert [r.i for r in df.where(P.residual(F.col("b"), F.col("i") == 2)).collect()] == [1, 2, 3]
    assert df.where(P.any_of([])).count() == 0 and df.where(P.all_of([])).count() == 3
    left = P.exclude_keys(df, df.where("i = 2"), ["d"])
    assert sorted(r.i for r in left.collect()) == [1, 3]
    lab = spark.createDataFrame([(1, None), (2, ["x"]), (3, ["x", "y"])], "i int, l array<string>")
    assert [r.i for r in lab.where(P.has_labels(F.col("l"), ["x"], ["y"])).collect()] == [2]
    assert [r.i for r in lab.where(P.has_labels(F.col("l"), [], [])).collect()] == [1, 2, 3]


@pytest.mark.parametrize("cutoff", [0, 2])
def test_accounts_are_conserved(spark, cutoff):
    rows = [(u, h) for u in UNICODE for h in ("h1", "h2", None)] + [("café", "h1")]
    rules = spark.createDataFrame([("caf.*",), ("",)], "re string")
    out = []
    for data in (rows, rows[::-1], []):
        df = spark.createDataFrame(data, "v string, h string")
        stack, acc = S.accounted_stack(df, ["v"], "h", rules, {"v": "re"}, cutoff, 1)
        a = acc.first()
        assert a.eligible_rows == a.excluded_rows + a.matched_rows + a.residual_rows == len(data)
        assert a.eligible_groups == a.excluded_groups + a.matched_groups + a.residual_groups
        out.append(sorted(map(repr, (tuple(r) for r in stack.collect()))))
    assert out[0] == out[1] and out[2] == []


def test_ranges_and_packing(spark):
    df = spark.createDataFrame([("k", n) for n in (5, 3, 2, 1, 2, 0)] + [("z", 9)], "k string, n int")
    assert {tuple(r) for r in E.line_ranges(df, ["k"], "n").collect()} == {("k", "1-3,5"), ("z", "9")}
    w = spark.createDataFrame([("k", i, v) for i, v in enumerate([4, 4, 9, 1, None])] + [(None, 0, 2)], "k string, i int, w int")
    got = sorted((r.source or "", r.chunk, r.row_start, r.row_end, r.weight) for r in E.pack(w, "k", ["i"], F.col("w"), 8).collect())
    assert got == [("", 0, 1, 1, 2), ("k", 0, 1, 2, 8), ("k", 1, 3, 3, 9), ("k", 2, 4, 5, 1)]
    assert E.pack(w.where("false"), "k", ["i"], F.col("w"), 8).count() == 0
    kept = {tuple(r) for r in E.select_in_budget(w, "k", [F.col("i")], F.col("w"), 9, "i").collect()}
    assert kept == {("k", "0"), ("k", "1"), ("k", "3"), ("k", "4"), (None, "0")}


def test_numbering_spans_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("x"))
    got = numbered(df, ["x"], "n", F.col("x")).collect()
    assert all(r.n == r.x + 1 and r.n_sum == r.x * (r.x + 1) // 2 for r in got) and len(got) == 1000
    assert numbered(df.where("x < 0"), ["x"]).count() == 0


def test_rules(spark):
    p = spark.createDataFrame([("a.*",), ("(?=x)",), (r"(a)\1",), ("a*+",), (None,)], "p string")
    assert [r[0] for r in p.select(G.usable_rule(F.col("p"))).collect()] == [True, False, False, False, False]
    old = spark.createDataFrame([("a", "1", "d0"), ("b", "1", "d0"), (None, "1", "d0")], "k string, t string, d string")
    new = spark.createDataFrame([("a", "2", "d1"), (None, "1", "d1"), ("c", "1", "d1")], "k string, t string, d string")
    assert {tuple(r) for r in G.diff(old, new, ["k"], "t").collect()} == {("a", "updated"), ("b", "removed"), (None, "unchanged"), ("c", "added")}
    up = {tuple(r) for r in G.upsert(old.where("k is not null"), new.where("k is not null"), ["k"], "t", "d").collect()}
    assert up == {("a", "2", "d1"), ("b", "1", "d0"), ("c", "1", "d1")}
    with pytest.raises(Exception, match="different payloads"):
        G.merge([old, new], ["k"], "t", strict=True).collect()


def test_joined_rules_as_literal_ones(spark, monkeypatch):
    df = spark.createDataFrame([("a1", "x"), ("A2", None), (None, "x"), ("b", "y")], "i string, l string")
    rules = spark.createDataFrame([("a\\d", ".*"), ("", "X"), (None, ".*"), ("b", "z")], "ri string, rl string")
    few = {tuple(r) for r in S.unmatched(df, rules, {"i": "ri", "l": "rl"}).collect()}
    monkeypatch.setattr(S, "LITERAL_RULES", 0)
    many = {tuple(r) for r in S.unmatched(df, rules, {"i": "ri", "l": "rl"}).collect()}
    assert few == many == {("b", "y")}


def test_findings(spark):
    df = spark.createDataFrame([("a10",), ("a9",), ("A1",)], "i string")
    assert [r.i for r in df.orderBy(D.natural_key(F.col("i"))).collect()] == ["A1", "a9", "a10"]
    r = D.probe(spark.range(5), ["id"], 3).collect()
    assert [x.id for x in r] == [0, 1, 2] and all(x.truncated for x in r)
    assert not D.probe(spark.range(3), ["id"], 3).first().truncated


def test_signatures_and_profile(spark):
    df = spark.createDataFrame([("s", "a")] * 8 + [("s", "b"), ("s", None)], "s string, d string")
    r = S.signatures(df, "s", ["d"]).first()
    assert (r.row_count, r.signatures, r.leading, r.leading_rows, r["class"]) == (10, 3, 1, 8, "repetitive")
    p = S.field_profile(df, ["d"]).first()
    assert (p.null_count, p.filled_count, p.distinct_count, p.examples) == (1, 9, 2, ["a", "b"])
    n = spark.createDataFrame([("x" * i,) for i in range(1, 21)], "v string")
    assert S.length_percentile(n, ["v"]).first().p_length == 19
