"""Numbers and running totals over a whole table without bringing it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import cut, shuffle_partitions


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "n", weight: Column | None = None) -> DataFrame:
    """df with `name`, its place from 1 in the total order; with a weight also `name`_sum, the total up to and with the row.

    Rows are range-partitioned and sorted; each partition counts its own, and one row per partition tells where it starts.
    The order should be total, else ties are numbered in any order.
    """
    s = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    held = s.select("*", F.shiftright(place, 33).alias("_pid"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"), *([weight.cast("long").alias("_w")] if weight is not None else []))
    held = cut(held)
    ahead = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = held.groupBy("_pid").agg(F.count("*").alias("_c"), *([F.sum("_w").alias("_s")] if weight is not None else []))
    starts = parts.select("_pid", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0")] if weight is not None else []))
    out = held.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_n0") + F.col("_at") + 1)
    if weight is not None:
        within = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"{name}_sum", F.col("_s0") + F.sum("_w").over(within))
    return out.drop("_pid", "_at", "_n0", "_w", "_s0")


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """df with `name`, each row's place from 1 in its key's order, for keys of any size; null keys are keys.

    Rows are range-partitioned by key and order, so that a hot key is spread over as many partitions as it fills; per key and
    partition one row tells where counting goes on.
    """
    by = [*keys, *order]
    s = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()
    held = cut(s.select("*", F.shiftright(place, 33).alias("_pid"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    parts = held.groupBy(*keys, "_pid").agg(F.min("_at").alias("_a0"), F.count("*").alias("_c"))
    ahead = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_a0", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_n0"))
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = held.join(starts, on).withColumn(name, F.col("_n0") + F.col("_at") - F.col("_a0") + 1)
    return out.select(*df.columns, name)
