"""Structured Streaming forms of the operators.

A stream's state is bounded by its watermark: rows later than ``LATENESS`` behind the newest are dropped, and keys older than that are
forgotten. The table of latest versions has no such bound and lives in a snapshot that every micro-batch merges into.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merge import Snapshot

LATENESS = "14 days"


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    """A folder for one run's progress, in the shared folder that the session names."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tenderline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder's or file's Parquet as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    # As a pattern, the path may be a single file too.
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into Parquet, and reads the result."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def deduplicated(stream: DataFrame, keys: list[str], ts: str, lateness: str = LATENESS) -> DataFrame:
    """Each key once while the watermark remembers it."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, ts: str, keys: list[str], size: str, aggregates: list, lateness: str = LATENESS) -> DataFrame:
    """Tumbling windows that close when the watermark passes them."""
    out = stream.withWatermark(ts, lateness).groupBy(F.window(ts, size), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *[c for c in out.columns if c not in ("window", *keys)])


def latest_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_latest(stream: DataFrame, table: Snapshot, keys: list[str], order: Callable[[], list], progress: str) -> None:
    """Merges every micro-batch into the table of the latest row of each key; a batch that is replayed changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = latest_of(batch, keys, order())
        if table.version():
            rows = latest_of(table.read().unionByName(rows), keys, order())
        table.write(rows)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_updates(stream: DataFrame, table: Snapshot, keys: list[str], progress: str) -> None:
    """Keeps the last state of each key of an aggregated stream, those that the watermark has not passed included."""

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        table.write(table.read().join(batch, keys, "left_anti").unionByName(batch) if table.version() else batch)
        batch.unpersist()

    query = stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
