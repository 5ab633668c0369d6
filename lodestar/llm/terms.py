"""Frequency of every distinct term: a global integer dictionary with count arrays summed by identifier range.

Each task encodes its terms against a local dictionary and accumulates blocks of count arrays (occurrences and records). The
distinct terms of all blocks, sorted and numbered, are the global dictionary; blocks are encoded with it, and their counts are
summed in arrays, one for each range of identifiers. A term, however hot, crosses a shuffle once per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.numbering import numbered
from lodestar.session import shuffle_partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is handed on when its local dictionary holds so many terms; it bounds memory and drops nothing.
BLOCK_TERMS = 200_000
_PARTIAL = "field tinyint, term string, occurrences bigint, records bigint"
_SUMS = "term_id bigint, occurrences bigint, records bigint"
#: Identifiers of a range, whose counts one task holds as arrays.
RANGE_IDS = 65_536


def fold_ascii(c: Column) -> Column:
    """A–Z to a–z; every other letter keeps its case."""
    return F.translate(c, UPPER, LOWER)


def word_terms(c: Column) -> Column:
    """The longest runs of Unicode letters, numbers and underscores, ASCII-folded."""
    return F.regexp_extract_all(fold_ascii(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def value_terms(c: Column) -> Column:
    """The whole value without white space at its ends, ASCII-folded, as the only term."""
    return F.array(F.regexp_replace(fold_ascii(c), r"(?U)^\s+|\s+$", ""))


def has_value(c: Column) -> Column:
    """Not null and not only white space of any kind."""
    return c.rlike(r"(?U)\S")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field, terms) to partial counts (field, term, occurrences, records), one row per term and block.

    The empty term counts the records that have a value.
    """
    ids: dict[tuple[int, str], int] = {}
    occ, rec = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def flush() -> pa.RecordBatch:
        m = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in ids], pa.int8()), pa.array([k[1] for k in ids], pa.string()), pa.array(occ[:m]), pa.array(rec[:m])],
            names=["field", "term", "occurrences", "records"],
        )

    for b in batches:
        for f in np.unique(b.column(0).to_numpy()):
            mine = b.filter(pc.equal(b.column(0), int(f)))
            lists = mine.column(1)
            flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            coded = flat.dictionary_encode()
            names, codes = [""] + coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64) + 1
            n_occ = np.bincount(codes, minlength=len(names))
            seen = np.unique(owner * len(names) + codes) % len(names)
            n_rec = np.bincount(seen, minlength=len(names))
            n_occ[0] = n_rec[0] = mine.num_rows
            local = np.fromiter((ids.setdefault((int(f), t), len(ids)) for t in names), np.int64, len(names))
            if len(ids) > len(occ):
                grow = max(len(ids), 2 * len(occ))
                occ, rec = np.concatenate([occ, np.zeros(grow - len(occ), np.int64)]), np.concatenate([rec, np.zeros(grow - len(rec), np.int64)])
            occ[local] += n_occ
            rec[local] += n_rec
        if len(ids) >= BLOCK_TERMS:
            yield flush()
            ids.clear()
            occ[:], rec[:] = 0, 0
    if ids:
        yield flush()


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, term_id, occurrences, records), sorted by range, to one row per identifier; one range's arrays are held at a time."""
    now, sums = -1, np.zeros((2, RANGE_IDS), np.int64)

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array(at + now * RANGE_IDS), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["term_id", "occurrences", "records"])

    for b in batches:
        which, ids, *counts = [b.column(i).to_numpy() for i in range(4)]
        for r in np.unique(which).tolist():
            if r != now:
                if now >= 0:
                    yield out()
                now, sums[:] = r, 0
            mine = which == r
            for total, c in zip(sums, counts, strict=True):
                np.add.at(total, ids[mine] - r * RANGE_IDS, c[mine])
    if now >= 0:
        yield out()


def term_counts(fields: Sequence[tuple[str, DataFrame, str, str, str]], rare_records: int = 1, common_share: float = 0.05) -> DataFrame:
    """Every distinct term of every field with its counts and mark.

    fields: (field name, table, id column, value column, "word" or "value"). Result: term_id (a global number without gaps),
    field_name, term, occurrences, records, mark. Rows of a table with the same id and value are one record. Null and
    white-space-only values are left out and don't count as records. mark is `rare` for at most rare_records records, else
    `common` above common_share of the field's records that have a value, else null. Empty tables give no rows; other
    columns are ignored. A very long value is one row throughout; its terms are counted within its task.
    """
    spark = fields[0][1].sparkSession
    rows = None
    for i, (_, df, id_col, value_col, kind) in enumerate(fields):
        v = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("v")).where(has_value(F.col("v"))).distinct()
        part = v.select(F.lit(i).cast("tinyint").alias("field"), (word_terms if kind == "word" else value_terms)(F.col("v")).alias("terms"))
        rows = part if rows is None else rows.unionByName(part)
    partial = written(rows.mapInArrow(_blocks, _PARTIAL))
    terms = partial.where("term != ''")
    dictionary = numbered(terms.select("field", "term").distinct(), ["field", "term"]).select((F.col("n") - 1).alias("term_id"), "field", "term")
    coded = terms.join(dictionary, ["field", "term"]).select(F.floor(F.col("term_id") / RANGE_IDS).cast("long").alias("range"), "term_id", "occurrences", "records")
    sums = coded.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range").mapInArrow(_sum_ranges, _SUMS)
    # The empty term holds the number of records with a value: one row per field.
    total = partial.where("term = ''").groupBy("field").agg(F.sum("records").alias("total"))
    name = F.array(*[F.lit(f[0]) for f in fields])[F.col("field")]
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("total"), "common")
    return sums.join(dictionary, "term_id").join(F.broadcast(total), "field").select("term_id", name.alias("field_name"), "term", "occurrences", "records", mark.alias("mark"))


def collection_terms(rules: DataFrame, known: DataFrame) -> DataFrame:
    """Terms of golden_rules.image_path and .signer and of autoruns_known_good.launch_string."""
    return term_counts(
        [
            ("image_path", rules, "rule_id", "image_path", "word"),
            ("signer", rules, "rule_id", "signer", "value"),
            ("launch_string", known, "record_id", "launch_string", "word"),
        ]
    )


def terms_found(rules: DataFrame, known: DataFrame) -> DataFrame:
    """p2_found: (field_name, term, mark) of the rare and the common terms."""
    return collection_terms(rules, known).where("mark is not null").select("field_name", "term", "mark")
