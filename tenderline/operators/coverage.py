"""Which days of a range are there, which are missing, and how fresh they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Distinct days -> maximal runs: keys, date_from, date_to."""
    w = Window.partitionBy(*keys).orderBy(day)
    run = F.date_sub(F.col(day), F.row_number().over(w))
    return days.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(day).alias("date_from"), F.max(day).alias("date_to")).drop("_run")


def gaps(intervals: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of ``wanted`` (keys, date_from, date_to) that no interval (same columns) covers.

    By sorted ends, not by days: each interval ends the gap before it, where the greatest end so far lies before its start.
    """
    w = wanted.select(*keys, F.col("date_from").alias("_a"), F.col("date_to").alias("_b"))
    inside = w.join(intervals, keys, "left").where((F.col("date_from") <= F.col("_b")) & (F.col("date_to") >= F.col("_a")))
    marks = inside.select(*keys, "_a", "_b", "date_from", "date_to").unionByName(w.select(*keys, "_a", "_b", F.date_add("_b", 1).alias("date_from"), F.date_add("_b", 1).alias("date_to")))
    order = Window.partitionBy(*keys, "_a", "_b").orderBy("date_from", "date_to").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.date_add(F.max("date_to").over(order), 1), F.col("_a"))
    return marks.withColumn("_open", F.greatest(open_, F.col("_a"))).where(F.col("_open") < F.col("date_from")).select(*keys, F.col("_open").alias("date_from"), F.date_sub("date_from", 1).alias("date_to"))


def missing_days(wanted: DataFrame, have: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of wanted days that are not there."""
    return islands(wanted.join(have, [*keys, day], "left_anti"), keys, day)


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_from <= b_to) & (a_to >= b_from)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ranges (left: date_from, date_to; right: r_from, r_to) that share a day, by key: the key parts the work."""
    return left.join(right, keys).where(overlaps(F.col("date_from"), F.col("date_to"), F.col("r_from"), F.col("r_to")))


def fresh(cached_at: Column, now: Column, ttl: str = "24 hours", inclusive: bool = False) -> Column:
    """Cached within the time to live; the very edge only where ``inclusive``."""
    edge = now - F.expr(f"interval {ttl}")
    return cached_at >= edge if inclusive else cached_at > edge


def merged(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage of sources (keys, complete, fresh, missing: array of ranges) -> of the whole: all complete, all fresh, the union of what is missing in order."""
    return coverage.groupBy(*keys).agg(F.bool_and("complete").alias("complete"), F.bool_and("fresh").alias("fresh"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing"))


def best_prefix(entries: DataFrame, wanted_to: Column, keys: list[str]) -> DataFrame:
    """Of cached prefixes of a month, the shortest that covers the wanted day, else the longest."""
    covers = F.col("date_to") >= wanted_to
    short = F.min_by(F.struct(*entries.columns), F.when(covers, F.col("date_to")))
    long = F.max_by(F.struct(*entries.columns), F.col("date_to"))
    return entries.groupBy(*keys).agg(F.when(F.max(covers), short).otherwise(long).alias("e")).select("e.*")


def remaining(range_from: Column, range_to: Column, prefix_to: Column) -> Column:
    """What a cached prefix leaves: (from, to), null if nothing."""
    start = F.greatest(F.coalesce(F.date_add(prefix_to, 1), range_from), range_from)
    return F.when(start <= range_to, F.struct(start.alias("date_from"), range_to.alias("date_to")))


def delivery_plan(months: DataFrame, entries: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """For each month: complete, suffix or full, and the range to fetch. A stale prefix counts for nothing, a suffix keeps its prefix's cache time."""
    ok = entries.where(fresh(F.col("cached_at"), now)).select(*keys, F.col("window_from"), F.col("date_to").alias("prefix_to"), "cached_at")
    best = ok.groupBy(*keys, "window_from").agg(F.max_by(F.struct("prefix_to", "cached_at"), "prefix_to").alias("e"))
    out = months.join(best, [*keys, "window_from"], "left")
    rest = remaining(F.col("window_from"), F.col("window_to"), F.col("e.prefix_to"))
    kind = F.when(rest.isNull(), "complete").when(F.col("e").isNotNull(), "suffix").otherwise("full")
    return out.select(*keys, "window_from", "window_to", kind.alias("plan"), rest["date_from"].alias("fetch_from"), rest["date_to"].alias("fetch_to"), F.col("e.cached_at").alias("cached_at"))


def valid_entries(rows: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """Rows of the cache entries in which every row is valid."""
    bad = rows.where(~F.coalesce(valid, F.lit(False))).select(*keys).distinct()
    return rows.join(bad, keys, "left_anti")


def partly_there(wanted_from: Column, wanted_to: Column, missing: Column) -> Column:
    """Data counts as present unless the one missing range is the whole period."""
    only = F.get(missing, F.lit(0))
    return ~((F.size(missing) == 1) & (only["date_from"] == wanted_from) & (only["date_to"] == wanted_to))
