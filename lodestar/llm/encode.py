"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Frequent pieces are counted over all texts and compiled with their ids into a minimal acyclic transducer; workers
memory-map it, look all distinct pieces of a batch up in step, and merge the unseen ones exactly.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.lexicon import Lexicon, compile_lexicon
from lodestar.session import cut, put_shared

#: Where the public vocabulary files lie; never copied into this repository.
TOKENIZERS = "/opt/tokenizers"
#: How the pieces of byte_bpe_50k are cut (fixed by the tokenizer).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Frequent pieces held by the transducer; it only affects speed.
LEXICON_WORDS = 50_000
_SCHEMA = "doc_id bigint, ids array<int>"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the adjacent pair of the lowest rank is merged, leftmost first, until none is known.

    A heap over a linked list, so a piece of any length takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # part at i is word[i:end[i]]
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    gone = [False] * n
    while heap:
        r, i, e = heapq.heappop(heap)
        if gone[i]:
            continue
        j = end[i]
        if j >= n or end[j] != e or gone[j] or ranks.get(word[i:e]) != r:
            continue
        gone[j], end[i] = True, e
        if e < n:
            prev[e] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def frequent_pieces(texts: DataFrame, column: str, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces over all texts, at most `most`; of about equally frequent ones all or none.

    Cut in the JVM by nearly the same pattern: a difference only puts a piece in or out of the lexicon.
    """
    pieces = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?: ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+)"), F.lit(0))).alias("w"))
    counts = cut(pieces.where("length(w) <= 64").groupBy("w").count().where("count > 1"))
    # Counts are told apart to a sixteenth of an octave, so that the driver sees a bounded number of rows; of pieces in the
    # class that no longer fits none is kept.
    size = F.floor(F.log2("count") * 16)
    above, least = 0, -1
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        above += r["n"]
        if above > most:
            least = r["size"]
            break
    return [r["w"] for r in counts.where(size > least).select("w").collect()]


def publish(spark: SparkSession, data: bytes, stem: str) -> str:
    """Put a file into the shared folder and hand it to every executor; the name to ask SparkFiles for."""
    uri = put_shared(spark, data, stem)
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def encoder(lexicon_file: str, vocabulary: str):
    """The mapInArrow function of one lexicon and one vocabulary, both files handed to the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(SparkFiles.get(lexicon_file))
        ranks = load_ranks(SparkFiles.get(vocabulary))
        split = regex.compile(PIECES).findall
        for b in batches:
            texts = b.column(1).to_pylist()
            # Texts of a batch are taken in slices, so that very long ones don't pile up.
            at = 0
            while at < len(texts):
                size, z = 0, at
                while z < len(texts) and (z == at or size + len(texts[z] or "") <= 4_000_000):
                    size += len(texts[z] or "")
                    z += 1
                lists = [split(t) if t else [] for t in texts[at:z]]
                index: dict[str, int] = {}
                code = index.setdefault
                codes = np.fromiter((code(w, len(index)) for p in lists for w in p), np.int64)
                per_doc = np.fromiter(map(len, lists), np.int64, len(lists))
                words = [w.encode() for w in index]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                starts = np.cumsum(lengths) - lengths
                raw = np.frombuffer(b"".join(words), np.uint8)
                found = lex.ranks(raw, starts, lengths)
                known = np.flatnonzero(found >= 0)
                unseen = np.flatnonzero(found < 0)
                merged = [merge(words[i], ranks) for i in unseen]
                n_ids = np.zeros(len(words), np.int64)
                n_ids[known] = lex.starts[found[known] + 1] - lex.starts[found[known]]
                n_ids[unseen] = np.fromiter(map(len, merged), np.int64, len(merged))
                # One pool of ids: the lexicon's, then those just merged.
                pool = np.concatenate([lex.ids, np.fromiter((x for m in merged for x in m), np.int32)])
                first = np.zeros(len(words), np.int64)
                first[known] = lex.starts[found[known]]
                first[unseen] = len(lex.ids) + np.cumsum(n_ids[unseen]) - n_ids[unseen]
                n = n_ids[codes]
                into = np.cumsum(n) - n
                ids = pool[np.repeat(first[codes] - into, n) + np.arange(n.sum())] if len(codes) else np.zeros(0, np.int32)
                word_end = np.concatenate([[0], np.cumsum(n)])
                doc_end = word_end[np.concatenate([[0], np.cumsum(per_doc)])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, z - at), pa.ListArray.from_arrays(pa.array(doc_end, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])
                at = z

    return run


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of every document: the token ids of its whole text, without special tokens.

    Text that looks like a special token is ordinary text. Empty and null texts give an empty list. Rows are kept as they
    are, repeated ids and null ids included; other columns are ignored. Texts longer than a task's memory can't be rows of a
    table; anything less is encoded whole. `vocabulary` is read on the driver and handed to the executors.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranks = load_ranks(vocabulary)
    lexicon = compile_lexicon((w.encode(), merge(w.encode(), ranks)) for w in frequent_pieces(d, "text"))
    with open(vocabulary, "rb") as f:
        words = publish(spark, f.read(), "vocabulary")
    return d.mapInArrow(encoder(publish(spark, lexicon, "lexicon"), words), _SCHEMA)
