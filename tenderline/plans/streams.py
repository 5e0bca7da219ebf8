"""Streams over the events table, drained; their SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.merge import Snapshot
from ..streaming import streams


def latest_version_stream(spark, sf_dir):
    """The last event of each user, kept by merging micro-batches into a snapshot."""
    path = streams.checkpoint_dir(spark, "latest")
    table = Snapshot(spark, f"{path}/table")
    rows = streams.source(spark, f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    streams.keep_latest(rows, table, ["user_id"], lambda: [F.col("ts").desc(), F.col("event_id").desc()], f"{path}/progress")
    return table.read().select("user_id", "event_id", "event_type")


latest_version_stream.sql = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def dedupe_stream(spark, sf_dir):
    """The distinct (user, type, day) of a stream; the table spans more than the lateness, so the days' windows are the keys."""
    rows = streams.source(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("at"))
    out = streams.deduplicated(rows, ["user_id", "event_type", "day"], "at", "60 days")
    return streams.drain(out, streams.checkpoint_dir(spark, "dedupe")).select("user_id", "event_type", "day")


dedupe_stream.sql = "SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events"


def windowed_counts_stream(spark, sf_dir):
    """Events by day and type, windows that are still open included."""
    rows = streams.source(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    out = streams.windowed(rows, "at", ["event_type"], "1 day", [F.count("*").alias("n")])
    path = streams.checkpoint_dir(spark, "windows")
    table = Snapshot(spark, f"{path}/table")
    streams.keep_updates(out, table, ["window_start", "event_type"], f"{path}/progress")
    return table.read().select(F.to_date("window_start").alias("day"), "event_type", "n")


windowed_counts_stream.sql = "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL"

QUERIES = [latest_version_stream, dedupe_stream, windowed_counts_stream]
