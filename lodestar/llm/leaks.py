"""Evaluation texts leaking into training text: suffix arrays over shards of the corpus, searched with every test suffix.

Each batch of documents is a shard. Its words are numbers of the test vocabulary (0 for all others), and the suffixes that
begin with two test words are sorted to a depth of RUN words. Every test suffix is binary-searched: the depth at which its
interval becomes empty is its longest verbatim match in the shard, the intervals give all locations. A document with a
verbatim match of RUN words leaks; where a document has enough single words of an item, an exact in-order alignment decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many consecutive words of an item are a leak.
RUN = 10
#: Or so large a share of its words in their order.
SHARE = (2, 3)
#: What stands for a run of signs only until it is left out.
NO_WORD = -1
#: Characters of test items that are searched at a time; more are taken in blocks, each with a pass over the corpus.
ITEM_CHARS = 16_000_000
_SCHEMA = "doc_id bigint, item_id bigint, longest int, matched int, words int, doc_word int, item_word int"
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
#: Scripts written without spaces: each ideograph and each sign of the scripts of Southeast Asia is a word, and each run of kana.
_SIGN = "\u3005\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_HIRAGANA, _KATAKANA = "\u3041-\u309f", "\u30a1-\u30ff\u31f0-\u31ff"
_UNSPACED = re.compile(f"[{_SIGN}{_HIRAGANA}{_KATAKANA}]")
_PART = re.compile(f"[{_SIGN}]|[{_HIRAGANA}]+|[{_KATAKANA}]+|(?:(?![{_SIGN}{_HIRAGANA}{_KATAKANA}])[^\\W_])+")
#: Format characters: zero-width spaces and joiners, soft hyphens, direction marks.
_APOSTROPHES = dict.fromkeys(map(ord, "'\u2018\u2019\u02bc\u0060\u00b4"))
_INVISIBLE = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits, compatibility-composed, in lower case.

    Invisible format characters and apostrophes vanish inside words; markup tags and all other signs part words. Scripts without
    spaces are parted by sign or by run of kana.
    """
    if "<" in text:
        text = _TAG.sub(" ", text)
    return [w for token in text.split() for w in token_words(token)]


def token_words(token: str) -> list[str]:
    """The words of a run without white space."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token.translate(_INVISIBLE))
        if _UNSPACED.search(token):
            return _PART.findall(token.translate(_APOSTROPHES).lower())
    return _WORD.findall(token.translate(_APOSTROPHES).lower())


class Encoder(dict):
    """Runs without white space to the number of their only word, 0 if no test has it, or a tuple of several words' numbers.

    Runs repeat, so each is taken apart once; the memory is cleared when it holds too many.
    """

    MOST = 500_000

    def __init__(self, vocab: dict[str, int]) -> None:
        super().__init__()
        self.vocab = vocab

    def __missing__(self, token: str) -> int | tuple[int, ...]:
        ids = tuple(self.vocab.get(w, 0) for w in token_words(token))
        out = ids[0] if len(ids) == 1 else ids if any(ids) else 0 if ids else NO_WORD
        if len(self) >= self.MOST:
            self.clear()
        self[token] = out
        return out

    def sequence(self, text: str) -> np.ndarray:
        """The word numbers of a text; a run of several words of which no test has any counts as one word."""
        if "<" in text:
            text = _TAG.sub(" ", text)
        ids = list(map(self.__getitem__, text.split()))
        if tuple in set(map(type, ids)):
            ids = [x for i in ids for x in (i if type(i) is tuple else (i,))]
        out = np.array(ids, np.int64)
        return out[out != NO_WORD]


@dataclass
class Tests:
    """The items as one sequence of word numbers; item boundaries are 0."""

    item_ids: np.ndarray
    seq: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    vocab: dict[str, int]

    @staticmethod
    def of(items: list[tuple[int, str | None]]) -> Tests:
        vocab: dict[str, int] = {}
        ids, seq, owner, starts, sizes = [], [], [], [], []
        for item_id, text in items:
            w = words(text) if text else []
            if not w or item_id is None:
                continue
            starts.append(len(seq))
            sizes.append(len(w))
            owner += [len(ids)] * (len(w) + 1)
            seq += [vocab.setdefault(x, len(vocab) + 1) for x in w] + [0]
            ids.append(item_id)
        seq += [0] * (RUN + 1)
        owner += [-1] * (RUN + 1)
        return Tests(np.array(ids, np.int64), np.array(seq, np.int64), np.array(owner, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64), vocab)


def suffix_array(seq: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions, codes): the suffixes of seq that begin with two words, sorted to `depth` words; a 0 ends a suffix.

    codes[d] numbers the distinct prefixes of d+1 words in sorted order, for the searches.
    """
    at = np.flatnonzero((seq[:-depth] > 0) & (seq[1 : len(seq) - depth + 1] > 0))
    if not len(at):
        return at, []
    cols = [seq[at + k] for k in range(depth)]
    alive = np.ones(len(at), bool)
    for k, c in enumerate(cols):  # nothing counts after the first 0
        alive &= c > 0
        cols[k] = np.where(alive, c, 0)
    order = np.lexsort(cols[::-1])
    at, cols = at[order], [c[order] for c in cols]
    new = np.zeros(len(at), bool)
    new[0] = True
    codes = []
    for c in cols:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        codes.append(np.cumsum(new) - 1)
    return at, [*codes, *cols]


def search(at: np.ndarray, tables: list[np.ndarray], tests: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longest match, first, last) of each test suffix; first:last is its interval of matches of two words or more."""
    depth = len(tables) // 2
    codes, cols = tables[:depth], tables[depth:]
    n = len(tests) - depth
    longest, lo2, hi2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(tests[:n] > 0)
    prefix = np.zeros(len(live), np.int64)
    wide = vocab + 1
    for d in range(depth):
        keys = (codes[d - 1] if d else np.zeros(len(at), np.int64)) * wide + cols[d]
        want = prefix * wide + tests[live + d]
        lo, hi = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
        ok = (hi > lo) & (tests[live + d] > 0)
        live, lo, hi = live[ok], lo[ok], hi[ok]
        if not len(live):
            break
        longest[live] = d + 1
        if d == 1:
            lo2[live], hi2[live] = lo, hi
        prefix = codes[d][lo]
    return longest, lo2, hi2


def aligned(item: np.ndarray, doc: np.ndarray) -> int:
    """The most words of item found in doc in their order where between neighbours at most one word is changed, dropped or
    inserted on either side."""
    where: dict[int, list[int]] = {}
    wanted = set(item.tolist())
    for j, w in enumerate(doc.tolist()):
        if w in wanted:
            where.setdefault(w, []).append(j)
    best: dict[tuple[int, int], int] = {}
    most = 0
    for i, w in enumerate(item.tolist()):
        for j in where.get(w, ()):
            v = 1 + max(best.get((i - a, j - b), 0) for a in (1, 2) for b in (1, 2))
            best[i, j] = v
            most = max(most, v)
    return most


def most_aligned(item: np.ndarray, doc: np.ndarray) -> int:
    """An upper bound of `aligned`: an alignment never passes two neighbouring words of the item that doc doesn't have."""
    there = np.zeros(int(max(item.max(), doc.max(initial=0))) + 1, bool)
    there[doc] = True
    have = there[item]
    part = np.cumsum(np.concatenate([[False], ~have[1:] & ~have[:-1]]))
    return int(np.bincount(part, have).max())


def most_chained(item: np.ndarray, doc: np.ndarray) -> int:
    """An upper bound of `aligned` too: an alignment never passes two neighbouring words of doc that the item doesn't have."""
    there = np.zeros(int(max(item.max(), doc.max(initial=0))) + 1, bool)
    there[item] = True
    at = np.flatnonzero(there[doc])
    ends = np.concatenate([[0], np.flatnonzero(np.diff(at) > 2) + 1, [len(at)]])
    return int(np.diff(ends).max())


def likely(tests: Tests, need: np.ndarray, seqs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(document, item) wherever the document has at least `need` words of the item, in any order: never fewer than align."""
    if not len(tests.starts):
        return
    there = np.zeros(len(tests.vocab) + 1, bool)
    for d, s in enumerate(seqs):
        there[s] = True
        there[0] = False
        have = np.add.reduceat(there[tests.seq], tests.starts, dtype=np.int64)
        there[s] = False
        for item in np.flatnonzero(have >= need):
            yield d, int(item)


def finder(tests: Tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tests.vocab)
        need = -(-tests.sizes * SHARE[0] // SHARE[1])
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                size, z = 0, at
                while z < len(texts) and (z == at or size + len(texts[z] or "") <= 8_000_000):
                    size += len(texts[z] or "")
                    z += 1
                yield from shard(ids[at:z], texts[at:z], encode, need)
                at = z

    def shard(ids, texts, encode, need) -> Iterator[pa.RecordBatch]:
        seqs = [encode.sequence(t) if t else np.zeros(0, np.int64) for t in texts]
        lengths = np.array([len(s) + 1 for s in seqs], np.int64)
        seq = np.zeros(int(lengths.sum()) + RUN + 1, np.int64)
        begins = np.cumsum(lengths) - lengths
        for s, o in zip(seqs, begins, strict=True):
            seq[o : o + len(s)] = s
        runs: dict[tuple[int, int], tuple] = dict.fromkeys(likely(tests, need, seqs), (0, None, None))
        for pair, *run in verbatim(seq, begins, list(runs)):
            runs[pair] = tuple(run)
        result: dict[tuple[int, int], list] = {}
        for (d, item), (longest, doc_word, item_word) in runs.items():
            size, matched = int(tests.sizes[item]), 0
            text = tests.seq[tests.starts[item] : tests.starts[item] + size]
            sure = longest >= min(RUN, size)
            if not sure and min(most_aligned(text, seqs[d]), most_chained(text, seqs[d])) >= need[item]:
                matched = aligned(text, seqs[d])
            if sure or matched >= need[item]:
                result[d, item] = [max(longest, 1), max(matched, longest), size, doc_word, item_word]
        rows = [(ids[d], int(tests.item_ids[i]), *v) for (d, i), v in result.items() if ids[d] is not None]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]]], names=["doc_id", "item_id", "longest", "matched", "words", "doc_word", "item_word"])

    def verbatim(seq, begins, wanted) -> Iterator[tuple]:
        # Longest runs of two words or more, with their first words: of the wanted pairs, and of all that are a leak by them.
        docs_of: dict[int, list[int]] = {}
        for d, item in wanted:
            docs_of.setdefault(item, []).append(d)
        positions, tables = suffix_array(seq, RUN)
        if not len(positions):
            return
        longest, lo, hi = search(positions, tables, tests.seq, len(tests.vocab))
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return
        n_hits = hi[found] - lo[found]
        # Locations are expanded in blocks of test suffixes of one item after another, so their number stays bounded.
        owner = tests.owner[found]
        for item in map(int, np.unique(owner)):
            mine = owner == item
            t = np.repeat(found[mine], n_hits[mine])
            first = np.repeat(lo[found[mine]] - (np.cumsum(n_hits[mine]) - n_hits[mine]), n_hits[mine])
            p = positions[first + np.arange(len(t))]
            doc = np.searchsorted(begins, p, "right") - 1
            # Matches that continue on the same diagonal are one verbatim run.
            order = np.lexsort((p, p - t))
            t, p, doc = t[order], p[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], ~((p[1:] - p[:-1] == 1) & (t[1:] - t[:-1] == 1) & (doc[1:] == doc[:-1]))]))
            run = np.diff(np.concatenate([starts, [len(p)]])) + 1
            run_doc = doc[starts]
            best = np.lexsort((p[starts], -run, run_doc))  # the first of the longest runs of each document
            best = best[np.concatenate([[True], run_doc[best][1:] != run_doc[best][:-1]])]
            for k in best[(run[best] >= min(RUN, int(tests.sizes[item]))) | np.isin(run_doc[best], docs_of.get(item, []))].tolist():
                at = starts[k]
                yield (int(run_doc[k]), item), int(run[k]), int(p[at] - begins[run_doc[k]]) + 1, int(t[at] - tests.starts[item]) + 1

    return run


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest, matched, words, doc_word, item_word): which documents leak which test items, one row each.

    A document leaks an item that it contains RUN consecutive words of, or SHARE of the words of in their order with only
    single words changed, dropped or inserted; an item of fewer than RUN words must be there whole or by SHARE. Case, signs,
    quote marks, invisible characters and line breaks don't count. longest is the longest verbatim run found, doc_word and
    item_word are the numbers (from 1) of its first word there and here, null for runs of one word; matched is the number of
    words in order. Null and empty texts on either side match nothing; several rows of one doc_id count as one document; null
    ids are left out. The held-out items are read on the driver in blocks of about ITEM_CHARS characters, so that what is sent
    to the tasks stays bounded; for each block the corpus is read once, and it is never shuffled.
    """
    held = items.select(F.col("item_id").cast("long").alias("item_id"), "item_text").where("item_id is not null")
    chars = held.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-chars // ITEM_CHARS))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for k in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()
        part = d.mapInArrow(finder(Tests.of([tuple(r) for r in rows])), _SCHEMA)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("longest", "words", "doc_word", "item_word"))
    found = found.groupBy("doc_id", "item_id").agg(best.alias("r"), F.max("matched").alias("matched"))
    return found.select("doc_id", "item_id", "r.longest", "matched", "r.words", "r.doc_word", "r.item_word")


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that leak no item; those without an id are kept, as no leak can name them."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def leaks_found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """p8_found: (doc_id, item_id)."""
    return find_leaks(docs, items).select("doc_id", "item_id")
