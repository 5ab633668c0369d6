import random

import numpy as np
import pytest

from lodestar.llm import leaks as L

ITEM = "Suppose the examiner receives kibe 4711, with a journal gap near l'hive, name the earliest safe claim on zotu, once the relay proves it; describe why alpha beta gamma delta matter here"


def edited(r, words, share):
    out, i = [], 0
    while i < len(words):
        x = r.random()
        if x < share:
            kind = r.randrange(3)
            if kind == 1:
                out.append(f"new{r.randrange(999)}")
            if kind == 2:
                out += [f"more{r.randrange(999)}", words[i]]
            if i + 1 < len(words):
                out.append(words[i + 1])
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


@pytest.fixture(scope="module")
def found(spark):
    w = ITEM.split()
    docs = {
        1: f"Before. {ITEM}. After",
        2: "x " + ITEM.upper().replace(" ", "\n> "),
        3: " ".join(w[3:13]),
        4: " ".join(w[3:12]),
        5: "**" + "** **".join(w) + "**",
        6: ITEM.replace("receives", "re\u00adcei\u200bves").replace("l'hive", "l\u2019hive").replace(" ", "\u00a0 "),
        7: " ".join(x if i % 6 else "changed" for i, x in enumerate(w)),
        8: " ".join(x for i, x in enumerate(w) if i % 6),
        9: " ".join(y for i, x in enumerate(w) for y in ([x] if i % 5 else ["put", x])),
        10: " ".join(x if i % 2 else "changed" for i, x in enumerate(w)),
        11: " ".join(x if i % 8 not in (3, 4, 5) else "zz" for i, x in enumerate(w)),
        12: " ".join(sorted(w)),
        13: "",
        14: None,
        15: "filler words " * 60_000 + ITEM,
        16: "short item text",
        17: "<b>" + ITEM.replace("gap near", "<i>gap</i> near") + "</b>",
    }
    rows = [(k, v, "en") for k, v in docs.items()] + [(1, docs[1], "en"), (None, ITEM, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "a short item text"), (None, ITEM)], "item_id long, item_text string")
    return d, items, {(r.doc_id, r.item_id) for r in L.leaks_found(d, items).collect()}


def test_found(found):
    assert found[2] == {(i, 1) for i in (1, 2, 3, 5, 6, 7, 8, 9, 15, 17)} | {(16, 4)}


def test_no_two_neighbouring_words_are_needed(spark):
    w = ITEM.split()
    docs = {
        1: " ".join(f"{x} new{i}" for i, x in enumerate(w)),
        2: " ".join("changed" if i % 3 == 1 and i < 30 else x for i, x in enumerate(w)),
        3: " ".join(("changed" if i % 3 == 1 and i < 30 else f"{x} put{i}" if i % 6 == 2 else x) for i, x in enumerate(w)),
        4: " ".join(f"{x} two words" for x in w),
        5: " ".join(f"{x} new{i}" for i, x in enumerate(reversed(w))),
        6: "one",
        7: "ones",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "one")], "item_id long, item_text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks_found(d, items).collect()} == {(1, 1), (2, 1), (3, 1), (6, 2)}


def test_finds_all_that_align():
    r = random.Random(3)
    items = [" ".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 16))) for _ in range(12)]
    tests = L.Tests.of(list(enumerate(items)))
    texts = [" ".join(r.choice("abcdefghijxyz") for _ in range(r.randrange(0, 60))) for _ in range(150)]
    batch = L.pa.RecordBatch.from_arrays([L.pa.array(range(len(texts)), L.pa.int64()), L.pa.array(texts)], names=["doc_id", "text"])
    got = {(d, i) for b in L.finder(tests)(iter([batch])) for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    want = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            number = np.array([tests.vocab.get(y, 0) for y in t.split()], np.int64)
            item = np.array([tests.vocab[y] for y in x.split()], np.int64)
            if 3 * L.aligned(item, number) >= 2 * len(item) or len(item) >= L.RUN and any(" ".join(x.split()[k : k + L.RUN]) in t for k in range(len(item) - L.RUN + 1)):
                want.add((d, i))
    assert got == want


def test_documents_without_leaks(found):
    d, items, _ = found
    left = L.without_leaks(d, L.find_leaks(d, items)).select("doc_id").collect()
    assert {r[0] for r in left} == {4, 10, 11, 12, 13, 14, None}


def test_empty(spark, found):
    d, items, _ = found
    assert L.leaks_found(d.where("false"), items).count() == 0 and L.leaks_found(d, items.where("false")).count() == 0


def test_longest_matches_as_brute_force():
    r = random.Random(1)
    for _ in range(30):
        tests = L.Tests.of([(i, " ".join(r.choice("abcd") for _ in range(r.randrange(1, 25)))) for i in range(3)])
        doc = [r.choice([0, 1, 2, 3, 4]) if r.random() < 0.9 else 0 for _ in range(80)]
        doc = [min(x, len(tests.vocab)) for x in doc]
        seq = np.array(doc + [0] * (L.RUN + 1))
        at, tables = L.suffix_array(seq, L.RUN)
        if not len(at):
            continue
        longest, lo, hi = L.search(at, tables, tests.seq, len(tests.vocab))
        for t in range(len(longest)):
            want = 0
            for p in at:
                k = 0
                while k < L.RUN and tests.seq[t + k] and tests.seq[t + k] == seq[p + k]:
                    k += 1
                want = max(want, k)
            assert longest[t] == want
            hits = {int(p) for p in at if tests.seq[t] and tests.seq[t + 1] and (seq[p], seq[p + 1]) == (tests.seq[t], tests.seq[t + 1])}
            assert set(at[lo[t] : hi[t]].tolist()) == hits


def test_alignment_of_random_edits():
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    number = {w: i + 1 for i, w in enumerate(words)}
    for share in (0.05, 0.15, 0.25):
        e = edited(r, words, share)
        doc = np.array([0, 0, *(number.get(w, 0) for w in e), 0])
        kept = sum(1 for w in e if w in number)
        assert L.aligned(np.arange(1, 61), doc) == kept <= L.most_aligned(np.arange(1, 61), doc)


def test_bound_is_never_less():
    r = np.random.default_rng(4)
    for _ in range(300):
        item, doc = r.integers(1, 9, r.integers(1, 20)), r.integers(0, 9, r.integers(0, 40))
        assert L.aligned(item, doc) <= L.most_aligned(item, doc)
        assert L.aligned(item, doc) <= L.most_chained(item, doc)


def test_words_without_spaces():
    assert L.words("攻撃者はpowershell.exeを実行した") == ["攻", "撃", "者", "は", "powershell", "exe", "を", "実", "行", "した"]
    assert L.words("<a href='" + "x" * 500 + "'>one</a> two") == ["one", "two"]


def test_unspaced_single_and_stretched_items_are_found(spark):
    items = [(1, "攻撃者は端末にログインしてファイルを削除した"), (2, "Zanzibar"), (3, " ".join(f"w{i}" for i in range(30)))]
    docs = [(1, "報告によれば、攻撃者は端末にログインしてファイルを削除したと思われる。"), (2, "I went to Zanzibar today"), (3, " ".join(f"w{i} x{i}" for i in range(30))), (4, "別の文章です")]
    got = L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_places_and_blocks_of_items(spark, monkeypatch):
    item = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "so it says: " + " ".join(f"v{i}" for i in range(5, 25)) + " and more"), (2, "v1 v2"), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "of no other use " * 5), (9, None)], "item_id long, item_text string")
    want = [(1, 7, 20, 20, 40, 4, 6)]
    assert [tuple(r) for r in L.find_leaks(docs, items).collect()] == want
    monkeypatch.setattr(L, "ITEM_CHARS", 60)
    assert [tuple(r) for r in L.find_leaks(docs, items).collect()] == want
    assert sorted(str(r.doc_id) for r in L.without_leaks(docs, L.find_leaks(docs, items)).collect()) == ["2", "None"]
