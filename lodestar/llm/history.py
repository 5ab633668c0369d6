"""New batches against all accepted history: a pivot-distance table in sorted ranges, probed by the rows of one batch at a time.

Every accepted key is stored with its distances to fixed pivots. Two keys within `radius` edits of each other have
distances to every pivot that differ by at most `radius`. Besides whole strings, every symbol has a pivot: the empty string,
seen through the projection that keeps only that symbol. The distance is then the count of the symbol; one edit changes those
counts by at most two in all, in at most two groups of symbols. With more than 2 * radius groups one group has the same
distances on both sides. A key is therefore stored once per group, at the position (group, its distances there, distance to
the first string pivot), and a new key is sent to the ranges that reach from `radius` below to `radius` above its position.

The table is a list of segments, each range-partitioned and sorted by position and written once. Accepted keys of a call
become a segment; it takes up those before it that are no larger, so that n keys lie in at most log n segments and a key is
rewritten log n times, without ever being compared or measured again. What a call costs is set by its own rows: their
distances, the ranges that they meet, and each other where they are of several batches. History never meets history.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.canonical import letters_digits
from lodestar.llm.runs import adjacent_runs
from lodestar.session import cut, drop_shared, get_shared, put_shared, shared_dir, shuffle_partitions, written

#: Keys looked at to choose pivots (those with the smallest hash, of up to so many characters); it only affects speed, every key is
#: indexed.
PIVOT_SAMPLE, PIVOT_LENGTH = 200, 256
PIVOTS = 6
#: Rows of a range of a segment; it only affects speed, no range is cut short.
RANGE_ROWS = 50_000
#: Groups of symbols with the highest count that is told apart, so that a group takes at most FIELD bits; spread so
#: that each group tells paths apart about as well.
GROUPS = (
    {"a": 9, "k": 6, "z": 6},
    {"e": 9, "p": 6, "v": 6},
    {"o": 9, "g": 6, "b": 4, "8": 2},
    {"i": 9, "f": 5, "n": 5, "6": 2},
    {"d": 6, "t": 6, "h": 5, "u": 4},
    {"r": 6, "m": 6, "c": 5, "x": 4},
    {"s": 6, "l": 6, "w": 5, "y": 4},
)
FIELD, _PER_LONG = 21, 3
LONGS = -(-len(GROUPS) // _PER_LONG)
#: Bits of a position that hold the distance to the first string pivot; greater distances count as the greatest.
_NEAR_BITS = 12
_FAR = (1 << _NEAR_BITS) - 1


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def choose_pivots(keys: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[str]:
    """n mutually distant keys from a bounded sample; fewer where there are fewer, at least the empty string."""
    short = keys.select("key").where(F.length("key") <= PIVOT_LENGTH)
    got = sorted(r[0] for r in short.orderBy(F.xxhash64("key"), "key").limit(sample).collect())
    pivots: list[str] = []
    far = {k: 1 << 30 for k in got}
    while far and len(pivots) < n:
        best = max(far, key=lambda k: (far[k], k))
        if far[best] == 0:
            break
        pivots.append(best)
        far = {k: min(v, _edits(k, best)) for k, v in far.items()}
    return pivots or [""]


def _symbol_long(i: int) -> Column:
    """The counts of the symbols of three groups as unary bits: the summed difference of two keys is the number of differing bits."""
    out, at = F.lit(0).cast("long"), 0
    for g, group in enumerate(GROUPS[_PER_LONG * i : _PER_LONG * (i + 1)]):
        at = FIELD * g
        for ch, most in group.items():
            count = F.length("key") - F.length(F.replace("key", F.lit(ch), F.lit("")))
            ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(count, F.lit(most))) - 1
            out, at = out.bitwiseOR(F.shiftleft(ones, at)), at + most
    return out


def pivot_table(keys: DataFrame, pivots: Sequence[str]) -> DataFrame:
    """keys with one column per pivot: p0.. (whole strings), c0.. (symbols) and len (the empty string)."""
    whole = [F.levenshtein(F.col("key"), F.lit(p)).alias(f"p{i}") for i, p in enumerate(pivots)]
    return keys.select("*", F.length("key").alias("len"), *whole, *[_symbol_long(i).alias(f"c{i}") for i in range(LONGS)])


def positions(table: DataFrame) -> DataFrame:
    """A row per key and group of symbols: pos, and the key's columns."""
    at = [
        f"shiftleft({g << FIELD}L + (shiftright(c{g // _PER_LONG}, {FIELD * (g % _PER_LONG)}) & {(1 << FIELD) - 1}L), {_NEAR_BITS}) + least(p0, {_FAR})"
        for g in range(len(GROUPS))
    ]
    return table.selectExpr(f"explode(array({', '.join(at)})) as pos", "*")


def _compare(radius: int, pivots: int):
    """The mapInArrow function from sorted (range, side, pos, kid, len, distances) to the pairs (a, b) that no pivot tells apart."""
    block, chunk = 256, 16_384

    def meet(held: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = np.searchsorted(held[0], n[0, 0] - radius, "left"), np.searchsorted(held[0], n[0, -1] + radius, "right")
        for u in range(x, y, chunk):
            f = held[:, u : min(y, u + chunk)]
            bits = sum(np.bitwise_count(f[i][:, None] ^ n[i][None, :]) for i in range(3 + pivots, 3 + pivots + LONGS))
            i, j = np.nonzero(bits <= 2 * radius)
            a, b = f[:, i], n[:, j]
            ok = (a[1] < b[1]) & (a[0] >> _NEAR_BITS == b[0] >> _NEAR_BITS) & (np.abs(a[2 : 3 + pivots] - b[2 : 3 + pivots]) <= radius).all(0)
            group = a[0] >> (FIELD + _NEAR_BITS)
            for g in range(len(GROUPS)):  # the pair is named in the first group that it shares
                mask = np.int64(((1 << FIELD) - 1) << FIELD * (g % _PER_LONG))
                row = 3 + pivots + g // _PER_LONG
                ok &= (group <= g) | (((a[row] ^ b[row]) & mask) != 0)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[1, ok]), pa.array(b[1, ok])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(batch.num_columns)])
            ends = np.flatnonzero((c[:2, 1:] != c[:2, :-1]).any(0)) + 1
            for lo, hi in zip([0, *ends], [*ends, c.shape[1]], strict=True):
                side, rows = c[1, lo], c[2:, lo:hi]
                if c[0, lo] != now:
                    now, parts, table = c[0, lo], [], None
                if side == 0:
                    parts.append(rows)
                    continue
                if table is None:
                    table = np.concatenate(parts, 1) if parts else np.zeros((rows.shape[0], 0), np.int64)
                for at in range(0, rows.shape[1], block):
                    yield from meet(table, rows[:, at : at + block])

    return run


@dataclass(frozen=True)
class Segment:
    """A sorted part of the table: its folder, its keys, and number, least and greatest position of each of its ranges."""

    path: str
    keys: int
    ranges: list[tuple[int, int, int]]


@dataclass
class History:
    """The accepted keys of all batches so far. `save` and `load` carry it from one session to the next."""

    pivots: list[str]
    segments: list[Segment] = field(default_factory=list)
    used: int = 0

    def columns(self) -> list[str]:
        return ["kid", "key", "len", *[f"p{i}" for i in range(len(self.pivots))], *[f"c{i}" for i in range(LONGS)]]

    def schema(self) -> str:
        numbers = [f"p{i} int" for i in range(len(self.pivots))] + [f"c{i} bigint" for i in range(LONGS)]
        return ", ".join(["pos bigint", "kid bigint", "key string", "len int", *numbers, "range int"])

    def read(self, spark: SparkSession, *segments: Segment) -> DataFrame:
        return spark.read.schema(self.schema()).parquet(*[s.path for s in segments])

    def keys(self, spark: SparkSession) -> DataFrame:
        """(kid, key): each accepted key once, kid is the smallest id that it was accepted with."""
        if not self.segments:
            return spark.createDataFrame([], "kid bigint, key string")
        return self.read(spark, *self.segments).where(F.shiftright("pos", FIELD + _NEAR_BITS) == 0).select("kid", "key")

    def append(self, accepted: DataFrame, most: int) -> None:
        """Add accepted keys, at most `most`, with their pivot columns. Smaller segments at the end are taken up, as they are."""
        spark = accepted.sparkSession
        rows, taken, n = positions(accepted.select(*self.columns())), [], most
        while self.segments and self.segments[-1].keys <= n:
            taken.append(self.segments.pop())
            n += taken[-1].keys
        if taken:
            rows = rows.unionByName(self.read(spark, *taken).drop("range"))
        parts = max(1, -(-n * len(GROUPS) // RANGE_ROWS))
        rows = rows.repartitionByRange(parts, "pos", "kid") if parts > 1 else rows.coalesce(1)
        counted, path = Observation(), f"{shared_dir(spark)}/segment-{uuid.uuid4().hex}"
        rows = rows.sortWithinPartitions("pos", "kid").withColumn("range", F.lit(self.used) + F.spark_partition_id())
        rows.observe(counted, F.count("*").alias("n")).write.parquet(path)
        ranges = [(self.used, 0, 1 << 62)]
        if parts > 1:  # one row per range
            ends = spark.read.schema(self.schema()).parquet(path).groupBy("range").agg(F.min("pos").alias("a"), F.max("pos").alias("z")).collect()
            ranges = sorted((r["range"], r["a"], r["z"]) for r in ends)
        self.used += parts
        self.segments.append(Segment(path, counted.get["n"] // len(GROUPS), ranges))
        for s in taken:
            drop_shared(spark, s.path)

    def reaching(self, table: DataFrame, radius: int) -> DataFrame:
        """A row per key, position and range that keys within `radius` of it may lie in: n_range, pos and the key's columns."""
        # The ends of the ranges are data of the plan, of a size set by their number; each probe is sent to those it reaches.
        ends = ", ".join(f"named_struct('n', {n}, 'a', {a}L, 'z', {z}L)" for s in self.segments for n, a, z in s.ranges)
        reached = f"transform(filter(array({ends}), e -> e.a <= pos + {radius} and e.z >= pos - {radius}), e -> e.n)"
        return positions(table).selectExpr("*", f"explode({reached}) as n_range")

    def meet(self, probes: DataFrame, radius: int) -> DataFrame:
        """(kid, key, first_id) of every pair of a probe and a stored key within `radius` edits of each other, at least once.

        Probes of a small batch are broadcast by the planner, and the stored ranges are read where they lie.
        """
        p = self.reaching(probes, radius).selectExpr("n_range", *[f"{c} as n_{c}" for c in ["pos", *self.columns()]])
        near = [f"abs({c} - n_{c}) <= {radius}" for c in ["len", *[f"p{i}" for i in range(len(self.pivots))]]]
        differ = " + ".join(f"bit_count(c{i} ^ n_c{i})" for i in range(LONGS))
        # What tells most pairs apart comes first.
        on = [f"range = n_range and shiftright(pos, {_NEAR_BITS}) = shiftright(n_pos, {_NEAR_BITS})", f"{differ} <= {2 * radius}", *near, f"levenshtein(key, n_key, {radius}) >= 0"]
        held = self.read(probes.sparkSession, *self.segments)
        return held.join(p, F.expr(" and ".join(on))).selectExpr("n_kid as kid", "n_key as key", "kid as first_id")

    def pairs(self, radius: int) -> DataFrame:
        """(a, b) of all pairs of stored keys within `radius` edits of each other, a < b, each once; for keys that are all new.

        Each key is sent to the ranges that it reaches. There the keys of the range are held, and those sent pass by in sorted
        blocks, so that a block meets only the held ones within its reach.
        """
        spark = SparkSession.active()
        stored = self.read(spark, *self.segments)
        cols = ["kid", "len", *[f"p{i}" for i in range(len(self.pivots))], *[f"c{i}" for i in range(LONGS)]]
        keys = stored.where(F.shiftright("pos", FIELD + _NEAR_BITS) == 0).select(*self.columns())
        held = stored.selectExpr("range", "0 as side", "pos", *cols)
        rows = held.unionByName(self.reaching(keys, radius).selectExpr("n_range as range", "1 as side", "pos", *cols))
        spread = rows.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range", "side", "pos")
        met = spread.mapInArrow(_compare(radius, len(self.pivots)), "a bigint, b bigint")
        a, b = keys.selectExpr("kid as a", "key as x"), keys.selectExpr("kid as b", "key as y")
        return met.join(a, "a").join(b, "b").where(F.levenshtein("x", "y", radius) >= 0).select("a", "b")

    def save(self, spark: SparkSession) -> str:
        """Write the list of segments to the shared folder; its URI for `load`."""
        return put_shared(spark, json.dumps(asdict(self)).encode(), "history", ".json")

    @staticmethod
    def load(spark: SparkSession, uri: str) -> History:
        d = json.loads(get_shared(spark, uri))
        return History(d["pivots"], [Segment(s["path"], s["keys"], [tuple(r) for r in s["ranges"]]) for s in d["segments"]], d["used"])


def _accepted(keys: DataFrame, links: DataFrame) -> DataFrame:
    """(kid, accepted) of the keys that have links, batch by batch: accepted unless linked to one accepted earlier.

    Each round settles every key whose earlier partners are all settled; there are at most as many rounds as batches.
    """
    earlier = cut(links.where("other_batch < batch").select("kid", "other"))
    waiting = earlier.select("kid").distinct().withColumn("waits", F.lit(True))
    state = cut(links.select("kid").distinct().join(waiting, "kid", "left").select("kid", F.when(F.col("waits").isNull(), F.lit(True)).alias("accepted")))
    while state.where("accepted is null").limit(1).count():
        seen = (
            earlier.join(state.select(F.col("kid").alias("other"), "accepted"), "other")
            .groupBy("kid")
            .agg(F.max(F.coalesce("accepted", F.lit(False))).alias("hit"), F.count_if(F.col("accepted").isNull()).alias("open"))
        )
        state = cut(state.join(seen, "kid", "left").select("kid", F.coalesce("accepted", F.when(F.col("hit"), F.lit(False)).when(F.col("open") == 0, F.lit(True))).alias("accepted")))
    return state


def _ends(rows: DataFrame) -> tuple[int | None, int | None]:
    """The first and the last batch."""
    return tuple(rows.agg(F.min("batch"), F.max("batch")).first())


def screen_near(rows: DataFrame, radius: int, history: History | None = None) -> tuple[DataFrame, History]:
    """(repeats, history) of (id, batch, key) rows screened in order of batch against `history` and each other.

    repeats(id, first_id): rows that lie within `radius` edits of a row accepted in an earlier batch; first_id is the smallest
    id of these. The returned history holds the newly accepted keys too and is passed to the next call, whose batches are
    later ones; the one given is used up. Rows of one batch don't repeat each other, so those of a single batch are compared
    with history only. Equal keys are compared once, as one class. Rows with a null key, id or batch are left out, an empty
    key is a key like any other, rows delivered twice are one; other columns are ignored. An empty table gives no repeats.
    """
    if 2 * radius >= len(GROUPS):
        raise ValueError(f"a radius of {radius} needs more than {2 * radius} groups of symbols")
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("batch").cast("long").alias("batch"), F.col("key").alias("key")).where("id is not null and batch is not null and key is not null")
    first = rows.groupBy("key").agg(F.min(F.struct("batch", "id")).alias("m")).select("key", F.col("m.batch").alias("batch"), F.col("m.id").alias("kid"))
    history = history or History(choose_pivots(first))
    # A key is measured once; distances cost more than the bytes of a key suggest, so they are spread over all tasks.
    new = cut(pivot_table(first.repartition(shuffle_partitions(spark)), history.pivots))
    n, low, high = new.agg(F.count("*"), F.min("batch"), F.max("batch")).first()
    if not n:
        return spark.createDataFrame([], "id bigint, first_id bigint"), history
    targets, fresh = [], new
    if history.segments:
        old = cut(history.meet(new, radius).groupBy("key").agg(F.min("first_id").alias("first_id")))
        targets.append(old.select("key", "first_id", F.lit(None).cast("long").alias("since")))
        fresh = new.join(old, "key", "left_anti")
    if low == _ends(rows)[1]:  # a single batch
        history.append(fresh, n)
    else:
        # What history refuses is no target, so the new rows meet those that it doesn't know.
        beside = History(history.pivots)
        beside.append(fresh, n)
        batch = new.select("key", "batch")
        near = cut(beside.pairs(radius))
        met = near.selectExpr("a as kid", "b as other").unionByName(near.selectExpr("b as kid", "a as other"))
        if targets:  # keys that history refuses may repeat newly accepted ones too
            met = met.unionByName(beside.meet(new.join(old, "key", "left_semi"), radius).selectExpr("kid", "first_id as other").distinct())
        who = new.select("kid", "key", "batch")
        links = cut(met.join(who, "kid").join(who.selectExpr("kid as other", "batch as other_batch"), "other").select("kid", "key", "batch", "other", "other_batch"))
        own = links.join(fresh.select("kid"), "kid", "left_semi")
        refused = _accepted(fresh, own).where("not accepted").select("kid")
        taken = cut(fresh.join(refused, "kid", "left_anti"))
        # What a key may repeat: itself, and its partners, if accepted; the batch of each decides for a row's batch.
        targets.append(links.join(taken.select(F.col("kid").alias("other")), "other", "left_semi").select("key", F.col("other").alias("first_id"), F.col("other_batch").alias("since")))
        targets.append(taken.select("key", F.col("kid").alias("first_id"), F.col("batch").alias("since")))
        history.append(taken, n)
        for s in beside.segments:
            drop_shared(spark, s.path)
    if not targets:
        return spark.createDataFrame([], "id bigint, first_id bigint"), history
    found = rows.join(reduce(DataFrame.unionByName, targets), "key").where("since is null or since < batch")
    return found.groupBy("id").agg(F.min("first_id").alias("first_id")), history


def screen_exact(rows: DataFrame, history: DataFrame | None = None, pivots: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(repeats, accepted) as in screen_near for radius 0: equal keys only, for keys held by any share of the rows.

    repeats(id, first_id); accepted(key, id): the classes that are new, to be appended to `history`, which has these columns.
    With radius 0 all pivot distances must agree, so the range partitions over the distances hold whole classes; sorted by
    batch, each class is scanned once against its first batch. What history holds is looked up by distinct keys before, so
    history is read once and neither sorted nor compared with itself. Rows with a null id, batch or key are left out.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "batch", "key").where("id is not null and key is not null and batch is not null")
    low, high = _ends(rows)
    repeats = spark.createDataFrame([], "id bigint, first_id bigint")
    if history is not None:
        # Written, so that history is read once for all that is made of it.
        known = written(history.select("key", F.col("id").alias("first_id")).join(rows.select("key").distinct(), "key", "left_semi"))
        repeats = rows.join(known, "key").groupBy("id").agg(F.min("first_id").alias("first_id"))
        rows = rows.join(known, "key", "left_anti")
    accepted = rows.groupBy("key").agg(F.min(F.struct("batch", "id"))["id"].alias("id"))
    if low != high:
        pivots = list(pivots) if pivots is not None else choose_pivots(rows.select("key").distinct(), 1)
        lead = [F.levenshtein(F.col("key"), F.lit(p)) for p in pivots]
        repeats = repeats.unionByName(adjacent_runs(rows, F.col("key"), F.col("batch"), F.col("id"), lead)[0])
    return repeats, accepted


def known_keys(known: DataFrame) -> DataFrame:
    """(id, batch, key) of known-good records."""
    k = letters_digits(F.col("hash_key"))
    return known.select(F.col("record_id").alias("id"), F.col("batch_no").alias("batch"), F.when(k != "", k).alias("key"))


def pattern_keys(rules: DataFrame) -> DataFrame:
    """(id, batch, key) of path patterns; a null pattern has no key, one without letters and digits the empty one."""
    r = letters_digits(F.col("image_path_regex"))
    return rules.select(F.col("rule_id").alias("id"), F.col("batch_no").alias("batch"), F.when(F.col("image_path_regex").isNotNull(), r).alias("key"))


def repeats_found(known: DataFrame, rules: DataFrame) -> DataFrame:
    """p6_found: (table_name, first_id, copy_id)."""
    exact, _ = screen_exact(known_keys(known))
    near, _ = screen_near(pattern_keys(rules), 3)
    return exact.select(F.lit("autoruns_known_good").alias("table_name"), "first_id", F.col("id").alias("copy_id")).unionByName(
        near.select(F.lit("autoruns_regex_rules").alias("table_name"), "first_id", F.col("id").alias("copy_id"))
    )


def batches_screened(known: DataFrame, rules: DataFrame) -> DataFrame:
    """(table_name, batch_no, record_id, first_id): every record once, first_id null for the new ones.

    The batches are taken one after the other, each against what was accepted before, as they would come in: a call sees the
    rows of one batch and the stored history. The driver sees one row per batch.
    """
    spark, folder = known.sparkSession, f"{shared_dir(known.sparkSession)}/batches-{uuid.uuid4().hex}"

    def batches(rows: DataFrame, name: str):
        once = rows.groupBy("id").agg(F.min("batch").alias("batch"), F.min("key").alias("key"))
        once.repartitionByRange(shuffle_partitions(spark), "batch", "id").write.partitionBy("batch").parquet(f"{folder}/{name}")
        all_ = spark.read.schema("id bigint, key string, batch bigint").parquet(f"{folder}/{name}")
        for b in sorted(r[0] for r in all_.select("batch").distinct().collect() if r[0] is not None):
            yield b, all_.where(F.col("batch") == b)

    def split(rows: DataFrame, repeats: DataFrame, name: str, b: int) -> None:
        out = rows.join(repeats, "id", "left").select(F.lit(name).alias("table_name"), F.col("batch").alias("batch_no"), F.col("id").alias("record_id"), "first_id")
        out.write.mode("append").parquet(f"{folder}/split")

    seen: list[str] = []
    for b, rows in batches(known_keys(known), "autoruns_known_good"):
        stored = spark.read.schema("key string, id bigint").parquet(*seen) if seen else None
        repeats, accepted = screen_exact(rows, stored)
        split(rows, repeats, "autoruns_known_good", b)
        seen.append(f"{folder}/accepted/batch={b}")
        accepted.write.parquet(seen[-1])
    history = None
    for b, rows in batches(pattern_keys(rules), "autoruns_regex_rules"):
        repeats, history = screen_near(rows, 3, history)
        split(rows, repeats, "autoruns_regex_rules", b)
    schema = "table_name string, batch_no bigint, record_id bigint, first_id bigint"
    return spark.read.schema(schema).parquet(f"{folder}/split") if seen or history else spark.createDataFrame([], schema)
