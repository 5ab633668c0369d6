import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import dedup, history, runs, terms
from lodestar.llm.canonical import letters_digits

RULES = "rule_id long, category string, image_path string, launch_string string, signer string, notes string, record_text string"
KNOWN = "record_id long, batch_no int, hash_key string, launch_string string"


def test_terms(spark):
    rules = spark.createDataFrame(
        [(1, None, "C:\\Foo\\foo.exe", None, " ÄB  Inc ", None, None), (1, None, "C:\\Foo\\foo.exe", None, " ÄB  Inc ", None, None), (2, None, "foo_bar x", None, "äB  inc", None, None), (3, None, " \u2003", None, "\t", None, None), (4, None, None, None, None, None, None)],
        RULES,
    ).withColumn("term", F.lit("clash"))
    known = spark.createDataFrame([(i, 1, None, "run --a" if i else "run " + "z " * 50_000) for i in range(30)], KNOWN)
    got = {(r.field_name, r.term): (r.occurrences, r.records, r.mark) for r in terms.collection_terms(rules, known).collect()}
    assert got == {
        ("image_path", "c"): (1, 1, "rare"),
        ("image_path", "foo"): (2, 1, "rare"),
        ("image_path", "exe"): (1, 1, "rare"),
        ("image_path", "foo_bar"): (1, 1, "rare"),
        ("image_path", "x"): (1, 1, "rare"),
        ("signer", "Äb  inc"): (1, 1, "rare"),
        ("signer", "äb  inc"): (1, 1, "rare"),
        ("launch_string", "run"): (30, 30, "common"),
        ("launch_string", "a"): (29, 29, "common"),
        ("launch_string", "z"): (50_000, 1, "rare"),
    }
    ids = [r.term_id for r in terms.collection_terms(rules, known).collect()]
    assert sorted(ids) == list(range(len(got)))
    assert terms.terms_found(rules.where("false"), known.where("false")).count() == 0


def test_blocks_are_summed(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 5).select("id", F.concat_ws(" ", F.lit("all"), (F.col("id") % 700).cast("string"), (F.col("id") % 700).cast("string")).alias("v"))
    got = {r.term: (r.occurrences, r.records) for r in terms.term_counts([("f", df, "id", "v", "word")]).collect()}
    want = Counter(str(i % 700) for i in range(5000))
    assert got == {"all": (5000, 5000)} | {k: (2 * n, n) for k, n in want.items()}


def brute(keyed):
    by = defaultdict(set)
    for i, k in keyed:
        if k is not None and i is not None:
            by[k].add(i)
    return {(x, min(s)) for s in by.values() for x in s if x != min(s)}, {(min(s), len(s)) for s in by.values()}


@pytest.mark.parametrize("seed", range(3))
def test_collapse_of_hot_keys(spark, seed):
    r = random.Random(seed)
    # One key holds a third of all rows, so that it spans partitions; some rows come twice, some are null.
    keyed = [(i, "hot" if r.random() < 0.34 else r.choice([f"k{r.randrange(400)}", None, ""])) for i in range(6000)]
    keyed += r.sample(keyed, 300)
    df = spark.createDataFrame(keyed, "id long, key string").repartition(7)
    copies, reps = dedup.collapse(df.withColumn("rank", F.lit("clash")))
    want = brute(keyed)
    got = copies.collect()
    assert len(got) == len(want[0]) and {(x.id, x.first_id) for x in got} == want[0]
    n = reps.collect()
    assert len(n) == len(want[1]) and {(x.first_id, x.n) for x in n} == want[1]


def test_rules_in_columns_and_records(spark):
    data = [
        (1, "Logon", r"c:\\a\.exe", "x --y", "Foo & Söhne", None, None),
        (2, None, None, None, None, None, '{"NOTES": null, "Launch String": "X  Y", "signer": "foo, S\\u00d6HNE", "Image Path": "C/a.EXE", "Category": " logon"}'),
        (3, None, None, None, None, None, "signer=FOO S_ÖHNE| ImagePath=c a|exe|launch_string=x=y|notes=|Category=LOGON"),
        (4, "Logon", r"c:\\a\.exe", "x --y", None, None, None),
        (5, "Logon", r"c:\\a\.exe", "x --y", " ", "n", None),
        (6, None, None, None, None, None, None),
        (7, "", "-", None, None, None, "{broken"),
    ]
    got = {tuple(r) for r in dedup.copies_found(spark.createDataFrame(data, RULES), spark.createDataFrame([], KNOWN)).collect()}
    assert got == {("golden_rules", 1, 2), ("golden_rules", 1, 3), ("golden_rules", 4, 5), ("golden_rules", 6, 7)}


def test_keys_without_letters_are_no_case(spark):
    data = [(1, 1, "AB-1", None), (2, 1, "{ab1}", None), (3, 1, "--", None), (4, 1, "", None), (5, 1, None, None), (6, 1, "x" * 100_000, None), (7, 1, "X" * 100_000 + " ", None)]
    got = {tuple(r) for r in dedup.copies_found(spark.createDataFrame([], RULES), spark.createDataFrame(data, KNOWN)).collect()}
    assert got == {("autoruns_known_good", 1, 2), ("autoruns_known_good", 6, 7)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def screened(rows, radius):
    accepted, out = [], set()
    for b in sorted({r[1] for r in rows}):
        new = []
        for i, k in sorted({(r[0], r[2]) for r in rows if r[1] == b}):
            hit = [j for j, x in accepted if abs(len(k) - len(x)) <= radius and edits(k, x) <= radius]
            if hit:
                out.add((i, min(hit)))
            else:
                new.append((i, k))
        accepted += new
    return out


def made(seed, n=260):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdehilnorstü7") for _ in range(r.randrange(2, 30))) for _ in range(30)]
    rows = []
    for i in range(n):
        k = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            p = r.randrange(len(k) + 1)
            k[p : p + r.randrange(2)] = r.choice(["", "x", "q"])
        rows.append((i, r.randrange(1, 6), "".join(k)))
    return rows + rows[:20]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, batch int, key string")


def pairs(df):
    got = df.collect()
    assert len(got) == len({r.id for r in got})
    return {(r.id, r.first_id) for r in got}


def test_near_repeats_as_brute_force(spark):
    rows = made(0)
    df = frame(spark, [*rows, (None, 1, "a"), (9999, None, "a"), (9998, 1, None)]).withColumn("kid", F.lit("clash")).withColumn("pos", F.lit(1))
    want = screened(rows, 3)
    assert pairs(history.screen_near(df, 3)[0]) == want
    # The same in two calls, the second against the history of the first, which another session may have written.
    first, kept = history.screen_near(df.where("batch <= 3"), 3)
    later, _ = history.screen_near(df.where("batch > 3"), 3, history.History.load(spark, kept.save(spark)))
    assert pairs(first) | pairs(later) == want
    # And batch by batch.
    kept, got = None, set()
    for b in range(1, 6):
        repeats, kept = history.screen_near(df.where(F.col("batch") == b), 3, kept)
        got |= pairs(repeats)
    assert got == want
    accepted = {r.kid for r in kept.keys(spark).collect()}
    assert accepted == {min(i for i, b2, k2 in rows if (b2, k2) == (b, k)) for i, b, k in rows if i not in dict(want)}


def test_history_never_meets_itself(spark, monkeypatch):
    rows = made(3, 600)
    _, kept = history.screen_near(frame(spark, [r for r in rows if r[1] <= 4]), 3)
    stored = {r.kid for r in kept.keys(spark).collect()}
    measured, met = [], []
    table, meet = history.pivot_table, history.History.meet
    monkeypatch.setattr(history, "pivot_table", lambda keys, pivots: measured.append(keys.count()) or table(keys, pivots))
    monkeypatch.setattr(history.History, "meet", lambda self, probes, radius: met.append({r.kid for r in probes.select("kid").collect()}) or meet(self, probes, radius))
    new = [r for r in rows if r[1] == 5]
    history.screen_near(frame(spark, new), 3, kept)
    keys = {k for _, _, k in new}
    # Only the new keys are measured and sent to the stored ones, whose number doesn't matter.
    assert measured == [len(keys)] and len(met) == 1 and len(met[0]) == len(keys) and not met[0] & stored


def test_many_ranges_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(history, "RANGE_ROWS", 40)
    rows = made(7) + [(1000 + i, 1 + i % 3, "samepath" * 3 + "abc"[i % 3]) for i in range(60)]
    want = screened(rows, 3)
    assert pairs(history.screen_near(frame(spark, rows), 3)[0]) == want
    first, kept = history.screen_near(frame(spark, [r for r in rows if r[1] <= 2]), 3)
    assert sum(len(s.ranges) for s in kept.segments) > 10
    later, kept = history.screen_near(frame(spark, [r for r in rows if r[1] > 2]), 3, kept)
    assert pairs(first) | pairs(later) == want


def test_segments_stay_few(spark):
    kept = None
    for b in range(9):
        _, kept = history.screen_near(frame(spark, [(10 * b + i, b, f"{'abcdefghi'[b] * 5}{'klmnopqrs'[i] * 5}") for i in range(4)]), 1, kept)
    assert [s.keys for s in kept.segments] == [32, 4]


def test_long_and_odd_keys(spark):
    rows = [(0, 1, "b" * 40_000), (1, 1, "a" * 2000), (2, 2, "a" * 1998), (3, 2, ""), (4, 3, "xy"), (5, 3, "bbbb"), (6, 4, "计算机安全"), (7, 5, "计算机安"), (8, 5, "A1")]
    assert pairs(history.screen_near(frame(spark, rows), 3)[0]) == {(2, 1), (4, 3), (7, 6), (8, 3)}
    assert pairs(history.screen_near(frame(spark, rows[:2]), 3)[0]) == set()


def test_exact_repeats(spark):
    rows = made(5) + [(2000 + i, 1 + i % 5, "hot") for i in range(150)]
    assert pairs(history.screen_exact(frame(spark, rows))[0]) == screened(rows, 0)
    first, kept = history.screen_exact(frame(spark, [r for r in rows if r[1] <= 3]))
    later, _ = history.screen_exact(frame(spark, [r for r in rows if r[1] > 3]), kept)
    assert pairs(first) | pairs(later) == screened(rows, 0)
    empty = frame(spark, [])
    assert history.screen_exact(empty)[0].count() == 0 and history.screen_near(empty, 3)[0].count() == 0


def test_batches_split_as_found(spark):
    rows = made(11, 120)
    known = frame(spark, rows).select(F.col("id").alias("record_id"), F.col("batch").alias("batch_no"), F.concat(F.lit("{"), F.upper("key"), F.lit("}")).alias("hash_key"))
    rules = frame(spark, rows).select(F.col("id").alias("rule_id"), F.col("batch").alias("batch_no"), F.col("key").alias("image_path_regex"))
    got = history.batches_screened(known, rules).collect()
    assert len(got) == 240
    found = {tuple(r) for r in history.repeats_found(known, rules).collect()}
    assert {(r.table_name, r.first_id, r.record_id) for r in got if r.first_id is not None} == found and len(found) > 60
    assert history.batches_screened(known.limit(0), rules.limit(0)).count() == 0


def test_letters_digits(spark):
    got = spark.createDataFrame([("Ab-1_ é\t计",), (None,), ("++",)], "v string").select(letters_digits(F.col("v"))).collect()
    assert [r[0] for r in got] == ["ab1é计", "", ""]


def test_scan_batches_of_one_row(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        keyed = [(i, f"k{i % 5}") for i in range(60)] + [(3, "k3"), (59, "k4")]
        df = spark.createDataFrame(keyed, "id long, key string")
        follow, heads = runs.adjacent_runs(df, F.col("key"), F.col("id"), F.col("id"))
        assert {(r.id, r.first_id) for r in follow.collect()} == brute(keyed)[0]
        assert {(r.first_id, r.n) for r in heads.collect()} == brute(keyed)[1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
