"""Contract search: filters, the latest log, order of the request, summaries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_numbers


def filtered(rows: DataFrame, key: str, numbers: list, day: str, date_from: date | None = None, date_to: date | None = None, category: str | None = None, category_column: str = "business_category") -> DataFrame:
    """Rows of the numbers within the inclusive range; category ``all`` or none means any. All conditions reach the scan."""
    out = rows.where(F.col(key).isin(numbers))
    if date_from:
        out = out.where(F.col(day) >= F.lit(date_from))
    if date_to:
        out = out.where(F.col(day) <= F.lit(date_to))
    if category and category != "all":
        out = out.where(F.col(category_column) == category)
    return out


def requested(spark: SparkSession, numbers: list, key: str) -> DataFrame:
    """A request's keys with their place, a bounded list."""
    return spark.createDataFrame([(k, n) for k, n in enumerate(numbers)], f"place int, {key} long" if numbers and isinstance(numbers[0], int) else f"place int, {key} string")


def in_request_order(rows: DataFrame, request: DataFrame, key: str, day: str, tie: str) -> DataFrame:
    """Rows of the requested keys, by the key's place, then newest first, numbered in that order within the place."""
    out = rows.join(F.broadcast(request), key)  # a request holds 50 numbers at most
    w = Window.partitionBy("place").orderBy(F.col(day).desc(), F.col(tie).desc())
    return out.withColumn("position", F.row_number().over(w))


def latest_log(logs: DataFrame, key: str, created: str, log_id: str, columns: list[str]) -> DataFrame:
    """One row a record: the last log, a higher id wins at the same time. An aggregate, so records with many logs are summed before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(created, log_id))
    return logs.groupBy(key).agg(best.alias("_l")).select(key, "_l.*")


def with_latest_log(rows: DataFrame, logs: DataFrame, key: str, created: str, log_id: str, columns: list[str]) -> DataFrame:
    return rows.join(latest_log(logs, key, created, log_id, columns), key, "left")


def summary(rows: DataFrame, total: Column, current: Column, linked: Column, day: str) -> DataFrame:
    """One row: count, sum of total (else current, else 0), rows linked to a notice, latest date."""
    return rows.agg(
        F.count("*").alias("contract_count"), F.coalesce(F.sum(F.coalesce(total, current, F.lit(0))), F.lit(0)).cast("long").alias("total_amount"),
        F.count_if(linked).alias("notice_linked_count"), F.max(day).alias("latest_contract_date"),
    )


def health(rows: DataFrame, runs: DataFrame, finished: str) -> DataFrame:
    """One row: how many rows there are, and when the last run ended."""
    return rows.agg(F.count("*").alias("row_count")).join(runs.agg(F.max(finished).alias("last_finished")), F.lit(True))


def capped_summary(rows: DataFrame, contract: str, amount: str, ceiling: str, notice: str, day: str) -> DataFrame:
    """One row over the newest rows of each contract: contracts, amounts capped by the contract's total, distinct notices, latest date."""
    each = rows.groupBy(contract).agg(F.sum(amount).alias("a"), F.max(ceiling).alias("c"), F.max(day).alias("d"))
    sums = each.agg(F.count("*").alias("contract_count"), F.coalesce(F.sum(F.least("a", F.coalesce("c", "a"))), F.lit(0)).cast("long").alias("total_amount"), F.max("d").alias("latest_contract_date"))
    notices = rows.where(F.col(notice).isNotNull()).select(notice).distinct().agg(F.count("*").alias("notice_linked_count"))
    return sums.join(notices, F.lit(True))


class Search:
    """The search of stored contracts as a request states it."""

    def __init__(self, spark: SparkSession, records: DataFrame, businesses: DataFrame, logs: DataFrame, hidden_dataset: str | None = None):
        self.spark, self.records, self.businesses, self.logs, self.hidden = spark, records, businesses, logs, hidden_dataset

    def rows(self, numbers: str, date_from: date | None = None, date_to: date | None = None, category: str | None = None) -> DataFrame:
        wanted = parse_numbers(numbers)
        rows = self.records if self.hidden is None else self.records.where(F.col("source_dataset") != self.hidden)
        rows = filtered(rows, "biz_no_normalized", wanted, "contract_date", date_from, date_to, category)
        names = self.businesses.select(F.col("id").alias("business_id"), "business_name", "biz_no_display")
        rows = rows.join(names, "business_id", "left")
        rows = with_latest_log(rows, self.logs.select(F.col("contract_record_id").alias("id"), F.col("id").alias("log_id"), "created_at", F.col("response_status").alias("latest_status"), F.col("error_message").alias("latest_error")), "id", "created_at", "log_id", ["latest_status", "latest_error"])
        return in_request_order(rows, requested(self.spark, wanted, "biz_no_normalized"), "biz_no_normalized", "contract_date", "id").orderBy("place", "position")
