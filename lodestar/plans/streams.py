"""Queries: streams run over the events that are there; each equals its batch counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.registry import Tables, query
from lodestar.session import shared_dir
from lodestar.streaming import stream


def _events(t: Tables) -> tuple[DataFrame, str]:
    """The events as a stream, and a folder of its own for state and output."""
    schema = t.events.schema
    return stream.read_stream(t.spark, t.path("event[s]"), schema, "ts", files_per_batch=1000), f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


@query("stream_running_stack", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    s, folder = _events(t)
    return stream.run_to_table(stream.running_stack(s, ["event_type", "user_id"]), folder, "complete")


@query("stream_overlap_dedup", "SELECT DISTINCT event_id FROM events")
def _(t: Tables) -> DataFrame:
    s, folder = _events(t)
    return stream.once_to_table(s.select("event_id"), ["event_id"], folder)


@query("stream_first_match", "SELECT min(event_id) AS event_id FROM events WHERE event_type = 'purchase' AND value > 30")
def _(t: Tables) -> DataFrame:
    s, folder = _events(t)
    hit = stream.first_match(s, (F.col("event_type") == "purchase") & (F.col("value") > 30), f"{folder}/state", ["event_id"])
    return hit.select("event_id") if hit is not None else t.events.where(F.lit(False)).select("event_id")
