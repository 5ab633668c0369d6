import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import split as S


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab .,\n日", max_size=120)), max_size=40), st.integers(1, 12), st.integers(1, 9), st.integers(0, 4))
def test_pieces_hold_limits_and_lose_nothing(rows, tokens, n, overlap):
    over, pieces = S.split_rows(rows, tokens, n, overlap)
    assert over == (sum(map(S.tokens, rows)) > tokens or len(rows) > n)
    if not over:
        assert [p["piece_rows"] for p in pieces] == ([rows] if rows else [])
        return
    text, before = [], []
    for p in pieces:
        assert sum(map(S.tokens, p["piece_rows"])) == p["tokens"] <= tokens and len(p["piece_rows"]) <= n
        o = p["overlap"]
        assert o <= overlap and (not o or before[-o:] == p["piece_rows"][:o] or len(before) < o)
        before = before + p["piece_rows"][o:] if len(before) < 50 else p["piece_rows"]
        text += p["piece_rows"][o:]
    assert "".join(x or "" for x in text) == "".join(x or "" for x in rows)
    assert [r for p in pieces for r in p["over_rows"]] == [i + 1 for i, r in enumerate(rows) if S.tokens(r) > tokens]


def test_cuts_at_the_strongest_break():
    text = "one two three. four five\n\nsix seven eight. nine ten"
    assert S.cut_text(text, 8) == ["one two three. four five\n\n", "six seven eight. nine ten"]
    assert S.cut_text("x" * 100, 5) == ["x" * 20] * 5
    assert S.cut_text("", 1) == [""]


def test_balanced():
    _, p = S.split_rows(["abcd"] * 100, 60, 1000, 0)
    assert [x["tokens"] for x in p] == [50, 50]
    _, p = S.split_rows(["abcd"] * 100, 1000, 40, 2)
    assert len(p) == 3 and all(x["overlap"] == 2 for x in p[1:]) and max(len(x["piece_rows"]) for x in p) <= 40


def test_parts_of_a_large_row_overlap():
    large = " ".join(f"word{i:04}" for i in range(400))
    rows = ["abcd" * 10] * 6 + [large] + ["abcd" * 10] * 6
    for overlap in (1, 2, 3):
        _, p = S.split_rows(rows, 300, 12, overlap)
        assert [x["overlap"] for x in p[1:]] == [overlap] * (len(p) - 1)
        assert all(a["piece_rows"][-overlap:] == b["piece_rows"][:overlap] for a, b in zip(p, p[1:], strict=False))
        assert max(x["tokens"] for x in p) <= 300 and max(len(x["piece_rows"]) for x in p) <= 12


def test_overlap_gives_way_only_where_it_cannot_fit():
    # The two rows of 8 can't share a piece, so the cut between them repeats nothing; all others repeat one row.
    assert [o for _, _, o in S.plan([1] * 9 + [8, 8] + [1] * 9, [2] * 20, 10, 99, 1)].count(0) == 2
    assert S.plan([3, 3, 3, 3], [2, 2, 1, 2], 6, 9, 0) == [(0, 2, 0), (2, 4, 0)]
    # Cut ranks hold beside such a place too.
    cuts = [a for a, _, _ in S.plan([8, 8] + [1] * 16, [2, 2] + [1] * 7 + [2] + [1] * 8, 10, 99, 1)]
    assert 1 in cuts and 9 in cuts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=9), st.integers(6, 12), st.integers(1, 5), st.integers(0, 3))
def test_plan_is_the_best_of_all(sizes, tokens, rows, overlap):
    n, ahead = len(sizes), min(overlap, rows - 1)
    costs = []
    for mask in range(1 << (n - 1)):
        cuts = [0, *[i for i in range(1, n) if mask >> (i - 1) & 1], n]
        short = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            o = next(o for o in range(min(ahead, a), -1, -1) if sum(sizes[a - o : a + 1]) <= tokens)
            if sum(sizes[a - o : b]) > tokens or b - a + o > rows:
                break
            short += (ahead - o) * (a > 0)
        else:
            costs.append((short, len(cuts) - 1))
    got = S.plan(sizes, [2] * n, tokens, rows, overlap)
    assert (sum(ahead - o for a, _, o in got if a), len(got)) == min(costs)


@pytest.fixture(scope="module")
def tables(spark):
    limits = spark.createDataFrame([(1, "d", 10, 3, 1), (2, "n", None, 2, 0)], "limits_id int, limits_name string, maximum_evidence_tokens_per_item long, maximum_analysis_item_rows long, overlap_rows int")
    rows = [(1, 1, ["a" * 40]), (2, 1, ["a" * 41]), (3, 1, [None] * 4), (4, 1, []), (5, 1, None), (6, 9, ["b" * 900]), (7, None, ["b" * 900]), (8, 2, ["c" * 90, "", ""]), (9, 1, ["d", json.dumps({"k": "e" * 300_000})])]
    return spark.createDataFrame([(*r, "mine") for r in rows], "batch_id long, limits_id int, batch_rows array<string>, tokens string"), limits


def test_found(tables):
    got = sorted(tuple(r) for r in S.oversized_found(*tables).collect())
    assert got == [(2, 0), (2, 1), (3, 0), (8, 0), (9, 0), (9, 2)]


def test_every_batch_comes_out(tables):
    p = S.split_batches(*tables).collect()
    assert {r.batch_id for r in p} == {1, 2, 3, 6, 7, 8, 9}
    assert {r.batch_id for r in p if r.pieces == 1} == {1, 6, 7}


def test_empty(spark, tables):
    assert S.oversized_found(tables[0].where("false"), tables[1]).count() == 0
    assert {r.pieces for r in S.split_batches(tables[0], tables[1].where("false")).collect()} == {1}


def test_parts_without_near_breaks_keep_escapes_and_marks_whole():
    for text in ("\\u00e4" * 300, "\\\\n" * 400, "é" * 500, "x" * 999, "ab cd, " + "y" * 50 + " ef" * 90):
        for limit in (3, 5, 16):
            parts = S.cut_text(text, limit)
            assert "".join(parts) == text and all(S.tokens(p) <= limit for p in parts)
            if text.startswith("\\u"):
                assert all(len(p) % 6 == 0 for p in parts)
            if text.startswith("e"):
                assert not any(p.startswith("́") for p in parts)


def test_pieces_of_all_batches(spark, small):
    batches, limits = spark.read.parquet(f"{small}/query_batches.parquet"), spark.read.parquet(f"{small}/analysis_limits.parquet")
    bound = {r.limits_id: r for r in limits.collect()}
    rows = {r.batch_id: (list(r.batch_rows or []), bound[r.limits_id]) for r in batches.collect()}
    got = {}
    for p in S.split_batches(batches, limits).orderBy("batch_id", "piece_no").collect():
        got.setdefault(p.batch_id, []).append(p)
    assert set(got) == {b for b, (r, _) in rows.items() if r}
    for b, pieces in got.items():
        want, lim = rows[b]
        text = []
        for p in pieces:
            assert sum(map(S.tokens, p.piece_rows)) == p.tokens <= lim.maximum_evidence_tokens_per_item
            assert len(p.piece_rows) <= lim.maximum_analysis_item_rows
            assert p.overlap <= lim.overlap_rows and p.piece_rows[: p.overlap] == (text[-p.overlap :] if p.overlap else [])
            text += p.piece_rows[p.overlap :]
        # Joined without what is repeated, the pieces give the batch again.
        assert "".join(x or "" for x in text) == "".join(x or "" for x in want)
        if len(pieces) == 1:
            assert text == want
