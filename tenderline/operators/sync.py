"""Planning and accounting of a collection run."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.errors import Unauthorized

COUNTERS = ["pages", "fetched", "matched", "inserted", "updated", "skipped", "errors"]
CATEGORIES = ["goods", "construction", "services", "foreign"]


def status(errors: Column, stored: Column) -> Column:
    """success without an error, failed with errors and nothing stored, else partial."""
    return F.when(errors == 0, "success").when(stored == 0, "failed").otherwise("partial")


def rollup(runs: DataFrame, keys: list[str], counters: list[str] = COUNTERS) -> DataFrame:
    """Counters summed over runs, and the status that follows from them."""
    out = runs.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters))
    return out.withColumn("status", status(F.col("errors"), F.col("inserted") + F.col("updated")))


def sources(category: str | None) -> list[str]:
    """Which sources a category needs."""
    if category == "shopping_third_party":
        return ["shopping"]
    return ["standard", "shopping"] if category in (None, "", "all") else ["standard"]


def months(date_from: date, date_to: date) -> list[tuple[date, date]]:
    """Calendar months that a range meets, cut off at its ends."""
    out, at = [], date_from
    while at <= date_to:
        after = date(at.year + at.month // 12, at.month % 12 + 1, 1)
        out.append((at, min(after - timedelta(1), date_to)))
        at = after
    return out


def refine(window: tuple[date, date]) -> list[tuple[date, date]]:
    """A window that is too large for the provider: a month becomes weeks, a week days, a day stays."""
    a, b = window
    days = (b - a).days + 1
    step = 7 if days > 7 else 1
    return [(a + timedelta(d), min(a + timedelta(d + step - 1), b)) for d in range(0, days, step)]


def fetch_all(windows: list[tuple[date, date]], fetch) -> tuple[list, list]:
    """(results, errors) of ``fetch(window)``; a ValueError for a range that is too large is answered by smaller ranges. Errors are (window, error)."""
    out, errors, todo = [], [], list(windows)
    while todo:
        w = todo.pop(0)
        try:
            out.append(fetch(w))
        except ValueError as e:
            if w[0] == w[1]:
                errors.append((w, e))
            else:
                todo = refine(w) + todo
        except Exception as e:  # noqa: BLE001  one window's failure does not end the others
            errors.append((w, e))
    return out, errors


def unauthorized_only(pages: int, errors: list) -> bool:
    """Whether nothing came and every error was a refused key: then another source is asked instead."""
    return not pages and bool(errors) and all(isinstance(e, Unauthorized) for _, e in errors)


def item_counts(items: DataFrame, mapped: DataFrame, item: list[str]) -> DataFrame:
    """One row: fetched items, matched rows, and items that made no row, each counted once."""
    made = mapped.groupBy(*item).agg(F.count("*").alias("n"))
    return items.select(*item).join(made, item, "left").agg(F.count("*").alias("fetched"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matched"), F.count_if(F.col("n").isNull()).alias("skipped"))


def header_matches(headers: DataFrame, number: str, request: str, method: str, needle: str) -> DataFrame:
    """Distinct request numbers of matching headers, with how many headers matched."""
    hit = headers.where(F.contains(F.col(method), F.lit(needle)) & (F.trim(request) != ""))
    return hit.groupBy(number).agg(F.array_sort(F.collect_set(request)).alias("requests"), F.count("*").alias("matched"))


def details(headers: DataFrame, lines: DataFrame, request: str) -> DataFrame:
    """Detail lines of the headers' requests only."""
    return lines.join(headers.select(request).distinct(), request, "left_semi")


def enrich_codes(rows: DataFrame, codes: DataFrame, key: str, own: str, found: str) -> DataFrame:
    """Rows without codes get those found under their key; looked up once a key."""
    c = codes.groupBy(key).agg(F.array_sort(F.collect_set(found)).alias("_c"))
    out = rows.join(c, key, "left")
    none = F.array().cast("array<string>")
    return out.withColumn(own, F.when(F.size(F.coalesce(own, none)) > 0, F.col(own)).otherwise(F.coalesce("_c", none))).drop("_c")


def enrich_lookups(rows: DataFrame, notices: DataFrame, contracts: DataFrame, bids: DataFrame) -> DataFrame:
    """Notice fields by notice number, contract fields by contract number and else by unified number, and whether a bid is known."""
    by_no = contracts.select(F.col("contract_no"), F.struct(*(c for c in contracts.columns if c not in ("contract_no", "unified_contract_no"))).alias("_a")).dropDuplicates(["contract_no"])
    by_unified = contracts.select(F.col("unified_contract_no"), F.struct(*(c for c in contracts.columns if c not in ("contract_no", "unified_contract_no"))).alias("_b")).dropDuplicates(["unified_contract_no"])
    out = rows.join(notices, "notice_no", "left").join(by_no, "contract_no", "left").join(by_unified, "unified_contract_no", "left")
    out = out.withColumn("contract", F.coalesce("_a", "_b")).drop("_a", "_b")
    return out.join(bids.select("notice_no").distinct().withColumn("bid_matched", F.lit(True)), "notice_no", "left").withColumn("bid_matched", F.coalesce("bid_matched", F.lit(False)))
