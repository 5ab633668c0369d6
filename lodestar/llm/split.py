"""Splitting oversized batches at natural boundaries into balanced pieces with overlap."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = (
    "batch_id bigint, piece_no int, pieces int, first_row bigint, last_row bigint, tokens bigint, overlap int, "
    "batch_over boolean, over_rows array<bigint>, piece_rows array<string>"
)
#: Breaks inside a text from the strongest to the weakest; in JSON text a line break is written as \n or \r.
_BREAKS = (
    re.compile(r"(?:\r\n|\r|\n|\\r\\n|\\n|\\r){2,}"),
    re.compile(r"\r\n|\r|\n|\\r\\n|\\n|\\r"),
    re.compile(r"[.!?](?=\s)\s*|[。！？]"),
    re.compile(r"[,;:、，](?=\s)\s*|[、，]"),
    re.compile(r"\s+"),
)
#: The beginning of an escape that a place lies in; an even number of backslashes before it are escapes of their own.
_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*(?P<body>\\(?:u[0-9a-fA-F]{0,3})?)\Z")
#: Rank of the cut between two rows; breaks inside a text rank below it.
_ROW_CUT, _PART_CUT = 2, 1


def tokens(text: str | None) -> int:
    """Characters divided by four, rounded up; 0 for null."""
    return 0 if text is None else -(-len(text) // 4)


def _whole(text: str, least: int, at: int) -> int:
    """The last place from least + 1 to `at` that parts neither an escape of JSON text nor a letter from its marks, else `at`."""
    b = at
    while b > least + 1 and b < len(text) and unicodedata.combining(text[b]):
        b -= 1
    tail = _ESCAPE.search(text, max(least, b - 12), b)
    if tail and (tail.end() - tail.start("body")) and tail.start("body") > least:
        b = tail.start("body")
    return b if b > least else at


def cut_text(text: str, limit: int) -> list[str]:
    """Balanced parts of text, each of at most `limit` tokens, that joined give the text again.

    The least number of parts gives equal-length targets; each moves to the strongest break within a quarter of a part,
    to the nearest of equals; where the parts then break the limit, one more is tried. Where that doesn't end soon, each part
    goes to the strongest break in the last half of what it may hold, else to the last one, and to the limit only where
    there is none.
    """
    limit = max(1, limit)
    if tokens(text) <= limit:
        return [text]
    breaks: dict[int, int] = {}
    for rank, pattern in enumerate(_BREAKS):
        for m in pattern.finditer(text):
            breaks.setdefault(m.end(), rank)
    at, size = sorted(breaks), 4 * limit
    least = -(-len(text) // size)
    for n in range(least, 2 * least + 3):
        step = len(text) / n
        cuts = [0]
        for k in range(1, n):
            target = round(k * step)
            lo, hi = bisect_left(at, target - step / 4), bisect_left(at, target + step / 4)
            near = [p for p in at[lo:hi] if p > cuts[-1]]
            cuts.append(min(near, key=lambda p: (breaks[p], abs(p - target))) if near else _whole(text, cuts[-1], max(target, cuts[-1] + 1)))
            if cuts[-1] - cuts[-2] > size:
                break
        cuts.append(len(text))
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        if all(tokens(p) <= limit for p in parts):
            return parts
    parts, a = [], 0
    while len(text) - a > size:
        lo, hi = bisect_left(at, a + size // 2), bisect_right(at, a + size)
        near = at[lo:hi]
        if near:
            b = min(near, key=lambda p: (breaks[p], -p))
        else:
            b = at[hi - 1] if hi and at[hi - 1] > a else _whole(text, a, a + size)
        parts.append(text[a:b])
        a = b
    return [*parts, text[a:]]


def plan(sizes: list[int], ranks: list[int], max_tokens: int, max_rows: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first new unit, end, units repeated before it) of each piece; units are rows or parts of rows, each within max_tokens.

    ranks[i] is the strength of the cut before unit i. Every piece but the first repeats the `overlap` units before it; at a
    cut where these and the next unit break a limit by themselves, only as many as fit. Of all plans those that repeat least
    too little are chosen, of these those with the least pieces; among their cuts each piece takes the strongest within a
    quarter of a piece of its balanced target, else the nearest.
    """
    n = len(sizes)
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    total, max_rows = ends[-1], max(1, max_rows)
    ahead = max(0, min(overlap, max_rows - 1))
    starts, reach, s = [], [], 0  # of a piece by its first new unit: its first repeated unit, its furthest end
    for a in range(n):
        s = max(s, a - ahead)
        while s < a and ends[a + 1] - ends[s] > max_tokens:
            s += 1
        starts.append(s)
        reach.append(min(n, s + max_rows, bisect_right(ends, ends[s] + max_tokens) - 1))
    # From the end: units too few repeated at and after a cut, times n + 1, plus pieces after it. `best` holds cuts within
    # reach, the later ones and cheaper at its right.
    after, best = [0] * (n + 1), deque()
    for a in range(n - 1, -1, -1):
        while best and after[best[0]] >= after[a + 1]:
            best.popleft()
        best.appendleft(a + 1)
        while best[-1] > reach[a]:
            best.pop()
        after[a] = after[best[-1]] + 1 + (ahead - a + starts[a]) * (n + 1) * (a > 0)
    # Targets share what binds, tokens or rows; where both do, both alike.
    by_tokens, by_rows = total / max(1, max_tokens), n / max_rows
    t, r = (1, 1) if by_tokens < 4 * by_rows and by_rows < 4 * by_tokens else (1, 0) if by_tokens >= by_rows else (0, 1)
    share = [t * e / max(1, total) + r * i / max(1, n) for i, e in enumerate(ends)]
    pieces, a = [], 0
    while a < n:
        cost = after[a] - 1 - (ahead - a + starts[a]) * (n + 1) * (a > 0)
        step = (share[n] - share[a]) / (after[a] % (n + 1))
        off = {b: abs(share[b] - share[a] - step) for b in range(a + 1, reach[a] + 1) if after[b] == cost}
        near = [b for b in off if off[b] <= step / 4 and b < n]
        b = min(near, key=lambda b: (-ranks[b], off[b])) if near else min(off, key=off.__getitem__)
        pieces.append((a, b, a - starts[a]))
        a = b
    return pieces


def split_rows(rows: list[str | None], max_tokens: int | None, max_rows: int | None, overlap: int) -> tuple[bool, list[dict]]:
    """(whether the batch came out in several pieces, these). A null limit doesn't bind; a batch without rows has no pieces.

    A row too large is cut into parts so small that a piece holds the repeated parts and as many new ones, if the row limit lets it.
    """
    max_tokens = max(1, max_tokens) if max_tokens is not None else 1 << 60
    max_rows = max_rows if max_rows is not None else 1 << 60
    sizes = [tokens(r) for r in rows]
    over = sum(sizes) > max_tokens or len(rows) > max_rows
    ahead = max(0, min(overlap, max_rows - 1))
    most = max(1, max_tokens // max(1, min(2 * ahead, max_rows)))
    units: list[tuple[int, str | None, int, bool]] = []  # row, text, rank of the cut before it, second part of a row too large
    for i, (r, s) in enumerate(zip(rows, sizes, strict=True)):
        if s > max_tokens:
            for j, part in enumerate(cut_text(r, most)):
                units.append((i + 1, part, _PART_CUT if j else _ROW_CUT, j == 1))
        else:
            units.append((i + 1, r, _ROW_CUT, False))
    unit_sizes = [tokens(u[1]) for u in units]
    pieces = plan(unit_sizes, [u[2] for u in units], max_tokens, max_rows, max(0, overlap)) if over else [(0, len(units), 0)] * bool(units)
    return len(pieces) > 1, [
        {
            "piece_no": k + 1,
            "pieces": len(pieces),
            "first_row": units[a - o][0],
            "last_row": units[b - 1][0],
            "tokens": sum(unit_sizes[a - o : b]),
            "overlap": o,
            "over_rows": [u[0] for u in units[a:b] if u[3]],
            "piece_rows": [u[1] for u in units[a - o : b]],
        }
        for k, (a, b, o) in enumerate(pieces)
    ]


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in _SCHEMA.split(", ")]
    for f in frames:
        out = []
        for bid, rows, t, r, o in zip(f["batch_id"], f["rows"], f["t"], f["r"], f["o"], strict=True):
            over, pieces = split_rows([] if rows is None else list(rows), None if pd.isna(t) else int(t), None if pd.isna(r) else int(r), 0 if pd.isna(o) else int(o))
            out += [{"batch_id": bid, "batch_over": over, **p} for p in pieces]
        yield pd.DataFrame(out, columns=cols)


def split_batches(batches: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every batch, each within both limits of the batch's limits_id.

    One row per piece: batch_id, piece_no of pieces, first_row and last_row (from 1, with the repeated ones), tokens,
    overlap (how many of its first rows repeat the piece before), batch_over (the batch had to be cut), over_rows (rows that
    had to be cut, whose second part is new here), piece_rows. A batch within its limits, or with unknown or null limits_id, is
    one piece; one without rows has none. A null row has size 0 and counts as a row. Rows keep their order and text; the
    parts of a row too large by itself joined give the row. limits is a fixed table of few rows and is broadcast.
    """
    lim = limits.select(
        F.col("limits_id").alias("lid"),
        F.col("maximum_evidence_tokens_per_item").alias("t"),
        F.col("maximum_analysis_item_rows").alias("r"),
        F.col("overlap_rows").alias("o"),
    ).dropDuplicates(["lid"])
    b = batches.select("batch_id", F.col("limits_id").alias("lid"), F.col("batch_rows").alias("rows"))
    return b.join(F.broadcast(lim), "lid", "left").select("batch_id", "rows", "t", "r", "o").mapInPandas(_pieces, _SCHEMA)


def oversized_found(batches: DataFrame, limits: DataFrame) -> DataFrame:
    """p1_found: (batch_id, row_no); 0 for a batch that its limits cut into pieces, k for a row that was cut itself."""
    p = split_batches(batches, limits)
    whole = F.when(F.col("batch_over") & (F.col("piece_no") == 1), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return p.select("batch_id", F.explode(F.concat(whole, "over_rows")).alias("row_no"))
