"""Streams: watching for a first match, reading on from a cursor with an overlap, running stacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, time: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder; `time` is cast to an instant so that watermarks can use it."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn(time, F.col(time).cast("timestamp")) if time else s


def once_within(stream: DataFrame, keys: Sequence[str], time: str, late: str = "5 minutes") -> DataFrame:
    """Rows whose keys weren't seen within the watermark; state is dropped as the watermark moves on."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def running_stack(stream: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Exact counts so far; every row counts, whatever a deduplication beside it forgets."""
    return stream.groupBy(*dims).agg(F.count("*").alias("n"))


def windowed_stack(stream: DataFrame, dims: Sequence[str], time: str, width: str, late: str = "5 minutes") -> DataFrame:
    """Counts per time window, final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *dims).agg(F.count("*").alias("n"))


def first_match(stream: DataFrame, cond: Column, checkpoint: str, order: Sequence[str], timeout_s: float | None = None) -> DataFrame | None:
    """The first row, in order, of all that match in any batch; None if there is none. TimeoutError if the stream is cut off."""
    found: list = []

    def look(batch: DataFrame, _: int) -> None:
        hits = batch.where(cond)
        if found:
            hits = hits.unionByName(batch.sparkSession.createDataFrame(found, batch.schema))
        found[:] = hits.orderBy(*order).limit(1).collect()

    q = stream.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if q.awaitTermination(timeout_s) is False:
            raise TimeoutError(f"the stream did not end within {timeout_s} s")
    finally:
        q.stop()
    return stream.sparkSession.createDataFrame(found, stream.schema) if found else None


def upsert_batches(stream: DataFrame, key: str, revision: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's newest revision per key to path; a batch that runs again replaces its own output only."""

    def write(batch: DataFrame, n: int) -> None:
        newest = batch.withColumn("_rev", revision).groupBy(key).agg(F.max_by(F.struct(*batch.columns), "_rev").alias("r"), F.max("_rev").alias("_rev"))
        newest.select("r.*", F.col("_rev").alias("revision")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since_cursor(df: DataFrame, time: Column, cursor: Column, cutoff: Column, overlap: str = "5 minutes") -> DataFrame:
    """Rows after the cursor less an overlap, up to the cutoff; rows without a time are always read again."""
    return df.where(time.isNull() | ((time > cursor - F.expr(f"interval {overlap}")) & (time <= cutoff)))


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a folder of batches and give the result: all batches, or the last if each is complete.

    A batch that runs again after a failure replaces its own output.
    """
    schema = stream.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out/*")


def once_to_table(stream: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """Run a stream over what is there and give one row per key, however late it comes: each batch leaves out what was written."""
    schema = stream.schema

    def write(batch: DataFrame, n: int) -> None:
        new = batch.dropDuplicates(list(keys))
        if n:
            before = batch.sparkSession.read.schema(schema).parquet(*[f"{folder}/out/batch={k}" for k in range(n)])
            seen = before.select(*[F.col(k).alias(f"_{k}") for k in keys])
            on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            new = new.join(seen, on, "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out/*")


def drain(df: DataFrame, name: str, mode: str = "append", transform: Callable | None = None) -> DataFrame:
    """Run a stream over what is there and give its result as a table; for tests and small jobs."""
    q = (transform(df) if transform else df).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
