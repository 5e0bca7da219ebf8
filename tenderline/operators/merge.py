"""Merges into snapshots: a snapshot is a written table, a merge makes the next one. Rows are never changed in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Which source's profile fields win; any other source has priority 0.
PROFILE_PRIORITY = {"user-info": 3, "excellent-products-csv": 2, "csv": 1}


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: str, kept: list[str], defaults: dict[str, Column]) -> DataFrame:
    """The next snapshot. Of equal keys in the source the last by ``order`` counts; columns in ``kept`` stay as they were on an update and start with ``defaults``."""
    last = source.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n", order)
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), last.withColumn("_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = t.join(s, on, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(f"t.{c}", f"s.{c}").alias(c))
        elif c in kept:
            out.append(F.when(F.col("_t"), F.col(f"t.{c}")).otherwise(defaults.get(c, F.lit(None))).alias(c))
        else:
            out.append(F.when(F.col("_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return joined.select(*out)


def upsert_counts(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """One row: inserted and updated. A new key's first row is an insert, its others are updates."""
    n = source.groupBy(*keys).agg(F.count("*").alias("n"))
    there = n.join(target.select(*keys).distinct().withColumn("_t", F.lit(True)), keys, "left")
    new = F.when(F.col("_t").isNull(), 1).otherwise(0)
    return there.agg(F.coalesce(F.sum(new), F.lit(0)).cast("long").alias("inserted"), F.coalesce(F.sum(F.col("n") - new), F.lit(0)).cast("long").alias("updated"))


def split_valid(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one): bad rows never reach the merge."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def priority(source: Column) -> Column:
    out = F.lit(0)
    for name, p in PROFILE_PRIORITY.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def merge_profiles(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str], order: str, source: str = "profile_source") -> DataFrame:
    """Profiles after a batch from one source, field by field, as if its rows came one by one.

    Null never overwrites. At the existing source's priority or above the last value that is not null wins; below it fills what is null,
    with the first such value. The source follows the same rule.
    """
    fields = [*fields, source]
    lasts = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_l_{f}") for f in fields]
    firsts = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_f_{f}") for f in fields]
    batch = incoming.groupBy(key).agg(F.max(priority(F.col(source))).alias("_p"), *lasts, *firsts)
    joined = existing.withColumn("_old", F.lit(True)).join(batch, key, "full")
    over = F.coalesce(F.col("_old"), F.lit(False)) & (F.coalesce(F.col("_p"), F.lit(-1)) < priority(F.col(source)))
    out = [F.when(over, F.coalesce(F.col(f), F.col(f"_f_{f}"))).otherwise(F.coalesce(F.col(f"_l_{f}"), F.col(f))).alias(f) for f in fields]
    return joined.select(key, *out)


def enrich(records: DataFrame, found: DataFrame, key: str, fields: list[str], status: str = "source_status") -> DataFrame:
    """Found values that are not null replace the record's; a record with any change is marked."""
    f = found.select(key, *(F.col(c).alias(f"_n_{c}") for c in fields))
    changed = F.reduce(F.array(*(F.col(f"_n_{c}").isNotNull() & ~F.col(f"_n_{c}").eqNullSafe(F.col(c)) for c in fields)), F.lit(False), lambda a, b: a | b)
    joined = records.join(f, key, "left").withColumn("_changed", changed)
    new = {c: F.coalesce(f"_n_{c}", c) for c in fields} | {status: F.when(F.col("_changed"), "api_enriched").otherwise(F.col(status))}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in records.columns))


class Snapshot:
    """A table as folders of Parquet and a numbered manifest for each version, of which the highest counts.

    Data goes to a folder of its own first; then the manifest that names it is created, never overwritten. So a write that fails at any
    point leaves the versions before it as they are, and of two writers of one version the second fails. The versions ``KEPT`` before
    the current one stay for readers that have begun. The folder must be one that all executors share.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, str]:
        """Folder names by version; a manifest without a name was never finished."""
        if not self._fs.exists(self._hadoop.Path(self.path)):
            return {}
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop.Path(self.path))]
        out = {}
        for n in sorted(int(x.removeprefix("manifest-")) for x in names if x.startswith("manifest-")):
            stream = self._fs.open(self._hadoop.Path(f"{self.path}/manifest-{n}"))
            try:
                out[n] = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        return out

    def version(self) -> int:
        """0: nothing has been written."""
        return max((n for n, folder in self._versions().items() if folder), default=0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._versions()[self.version()]}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        n = max(self._versions(), default=0) + 1
        folder = f"v{n}-{uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{folder}")
        out = self._fs.create(self._hadoop.Path(f"{self.path}/manifest-{n}"), False)
        out.write(bytearray(folder.encode()))
        out.close()
        for old, name in self._versions().items():
            if old < n - self.KEPT:
                if name:
                    self._fs.delete(self._hadoop.Path(f"{self.path}/{name}"), True)
                self._fs.delete(self._hadoop.Path(f"{self.path}/manifest-{old}"), False)
        return n

    def backup(self, to: str) -> None:
        """Copies what counts now and checks the copy's number of rows."""
        rows = self.read()
        copy = Snapshot(self.spark, to)
        copy.write(rows)
        if copy.read().count() != rows.count():
            raise RuntimeError("the copy is not whole")


def append(df: DataFrame, path: str) -> None:
    """Adds rows to an audit log."""
    df.write.mode("append").parquet(path)


def replace_ranges(cache: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """The cache without entries that meet a fetched range of their key, plus the fetched ones (keys, date_from, date_to, ...)."""
    new = fetched.select(*keys, F.col("date_from").alias("_a"), F.col("date_to").alias("_b")).distinct()
    old = cache.alias("c").join(new.alias("n"), [F.col(f"c.{k}") == F.col(f"n.{k}") for k in keys] + [F.col("c.date_from") <= F.col("_b"), F.col("c.date_to") >= F.col("_a")], "left_anti")
    return old.unionByName(fetched)


def preserve_prefix(entries: DataFrame, recent_from: Column, now: Column) -> DataFrame:
    """Entries cut off before the recent window and stamped anew; those that lie inside it fall away."""
    cut = entries.where(F.col("date_from") < recent_from)
    end = F.date_sub(recent_from, 1)
    return cut.withColumn("cached_at", F.when(F.col("date_to") > end, now).otherwise(F.col("cached_at"))).withColumn("date_to", F.least("date_to", end))
