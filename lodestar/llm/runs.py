"""External sort and scan of adjacent runs: the core of exact deduplication.

Rows are range-partitioned and sorted by (lead columns, key, rank, id), so that a key of any size is spread over as many
partitions as it fills. Each partition is scanned once, batch by batch, comparing full keys; only the head of the
current run is held. Runs that cross a partition border are stitched by one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import cut, shuffle_partitions

_SCHEMA = "kind tinyint, id bigint, rank bigint, first_id bigint, n bigint, edge boolean, pid int, key string"
_ARROW = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("rank", pa.int64()), ("first_id", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_()), ("pid", pa.int32()), ("key", pa.string())])
_ROW, _RUN = 0, 1


def _out(kind: int, ids, ranks, firsts, ns, edge, pid: int, keys=None) -> pa.RecordBatch:
    m = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(m, kind, np.int8)),
            pa.array(np.asarray(ids, np.int64)),
            pa.array(np.asarray(ranks, np.int64)),
            pa.array(np.asarray(firsts, np.int64)),
            pa.array(np.asarray(ns, np.int64)),
            pa.array(np.asarray(edge, bool)),
            pa.array(np.full(m, pid, np.int32)),
            pa.array(keys if keys is not None else [None] * m, pa.string()),
        ],
        schema=_ARROW,
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that follow their run's head in rank, all rows of the partition's first run, and one row per run.

    Input columns key, rank, id, sorted. A run is held as its head and its count, never as its rows.
    """
    pid = TaskContext.get().partitionId()
    head: tuple[str, int, int] | None = None  # key, rank, id
    last_id, count, runs = None, 0, 0
    for b in batches:
        m = b.num_rows
        if not m:
            continue
        key, rank, ids = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
        start = np.ones(m, bool)
        if m > 1:
            start[1:] = pc.not_equal(key.slice(1), key.slice(0, m - 1)).to_numpy(zero_copy_only=False)
        start[0] = head is None or key[0].as_py() != head[0]
        again = np.zeros(m, bool)  # the same record delivered again
        again[1:] = ~start[1:] & (ids[1:] == ids[:-1]) & (rank[1:] == rank[:-1])
        again[0] = not start[0] and ids[0] == last_id
        at = np.flatnonzero(start)
        own = np.maximum.accumulate(np.where(start, np.arange(m), -1))
        head_rank = np.where(own >= 0, rank[own], head[1] if head else 0)
        head_id = np.where(own >= 0, ids[own], head[2] if head else 0)
        run_no = runs + np.cumsum(start)
        first = run_no == 1
        keep = ~again & (first | (rank > head_rank))
        if keep.any():
            yield _out(_ROW, ids[keep], rank[keep], head_id[keep], np.zeros(keep.sum()), first[keep], pid)
        fresh = np.concatenate([[0], np.cumsum(~again)])
        if len(at):
            if head is not None:  # the carried run ends here
                yield _out(_RUN, [head[2]], [head[1]], [head[2]], [count + int(fresh[at[0]])], [runs == 1], pid, [head[0]] if runs == 1 else None)
            if len(at) > 1:
                is_first = run_no[at[:-1]] == 1
                names = [key[int(i)].as_py() if f else None for i, f in zip(at[:-1], is_first, strict=True)]
                yield _out(_RUN, ids[at[:-1]], rank[at[:-1]], ids[at[:-1]], fresh[at[1:]] - fresh[at[:-1]], is_first, pid, names)
            z = int(at[-1])
            head, count = (key[z].as_py(), int(rank[z]), int(ids[z])), int(fresh[m] - fresh[z])
        else:
            count += int(fresh[m])
        runs, last_id = int(run_no[-1]), int(ids[-1])
    if head is not None:
        yield _out(_RUN, [head[2]], [head[1]], [head[2]], [count], [True], pid, [head[0]])


def adjacent_runs(df: DataFrame, key: Column, rank: Column, id_: Column, lead: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(followers, runs) of the rows of df, grouped by equal key.

    followers(id, first_id): each record whose rank is above that of its run's head, once; first_id is the head's id.
    runs(first_id, n): each run's head and the exact number of its records; rows with equal key, rank and id are one.
    Within a run, records are ordered by rank, then id. Null keys are left out; empty input gives empty results.
    """
    spark = df.sparkSession
    lead = [c.alias(f"_lead{i}") for i, c in enumerate(lead)]
    names = [f"_lead{i}" for i in range(len(lead))]
    rows = df.select(*lead, key.alias("key"), rank.cast("long").alias("rank"), id_.cast("long").alias("id")).where("key is not null and id is not null")
    order = [*names, "key", "rank", "id"]
    parts = shuffle_partitions(spark)
    by_range = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    scanned = cut(by_range.select("key", "rank", "id").mapInArrow(_scan, _SCHEMA))
    # At most two edge runs per partition: their number is bounded by the number of partitions, not by the data.
    edges = scanned.where("kind = 1 and edge").groupBy("key").agg(F.min(F.struct("rank", "id")).alias("head"), F.sum("n").alias("n"))
    heads = scanned.where("kind = 1 and edge").select("pid", "key", "rank", "id")
    # The head of a partition's first run may lie in an earlier partition.
    follow = scanned.where("kind = 0 and not edge").select("id", "first_id")
    first_rows = scanned.where("kind = 0 and edge").select("id", "rank", "first_id", "pid")
    fix = (
        heads.join(F.broadcast(edges.select("key", "head")), "key")
        .select("pid", F.col("id").alias("first_id"), F.col("head.rank").alias("head_rank"), F.col("head.id").alias("head_id"))
        .distinct()
    )
    fixed = first_rows.join(F.broadcast(fix), ["pid", "first_id"]).where("rank > head_rank").select("id", F.col("head_id").alias("first_id"))
    runs = scanned.where("kind = 1 and not edge").select("first_id", "n").unionByName(edges.select(F.col("head.id").alias("first_id"), "n"))
    return follow.unionByName(fixed), runs
