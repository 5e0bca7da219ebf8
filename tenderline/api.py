"""What a user asks: import an index, search, export, enrich, look at health, and see the registry's sales of a period.

Tables are snapshots under one folder that all executors share. Every method returns DataFrames; nothing but counters and
parameters comes to the driver.
"""

from __future__ import annotations

import os
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .functions.identity import item_codes, overview_identity
from .functions.text import parse_numbers
from .operators import attribution, export, mappers, merge, overview, runs, search, sync, versions
from .operators.merge import Snapshot
from .sources import envelope
from .sources.csv_index import OPTIONAL, REQUIRED, read_index
from .sources.errors import Configuration, Input
from .sources.registry import TARGET_ITEM_CODE, registry

RECORD_KEYS = ["source_dataset", "source_row_hash"]
PERIOD_KEYS = {"period", "year", "month", "quarter"}
RUN = "source_name string, inserted long, updated long, errors long, finished_at timestamp, status string"
LOG = "id long, contract_record_id string, created_at string, response_status string, error_message string"
PROFILE = ["business_name", "representative_name", "address"]


def first_setting(names: list[str], env: dict[str, str] | None = None) -> str:
    """The first of some settings that is there and not blank; raises if none is."""
    env = os.environ if env is None else env
    for n in names:
        if env.get(n, "").strip():
            return env[n].strip()
    raise Configuration(f"none of {', '.join(names)} is set")


def storage_path(url: str) -> str:
    """A folder from a plain path or a ``file:`` URL; other local schemes are refused, those of shared stores pass."""
    if url.startswith("file:"):
        return "/" + url.removeprefix("file:").lstrip("/")
    scheme = url.split("://", 1)[0] if "://" in url else ""
    if scheme and scheme not in ("hdfs", "s3a", "abfss", "gs", "viewfs"):
        raise Configuration(f"{scheme} is no place for tables")
    return url


def period_of(pairs: list[tuple[str, str]], now: datetime | None = None) -> dates.Period:
    """A period from request parameters: known names only, each once, whole numbers."""
    names = [k for k, _ in pairs]
    if len(set(names)) != len(names) or not set(names) <= PERIOD_KEYS or not {"period", "year"} <= set(names):
        raise Input("period and year, and month or quarter, once each")
    values = dict(pairs)
    numbers = {}
    for k in ("year", "month", "quarter"):
        if k in values:
            if not values[k].isascii() or not values[k].isdigit():
                raise Input(f"{k} must be a whole number")
            numbers[k] = int(values[k])
    try:
        return dates.period(values["period"], **numbers, now=now)
    except ValueError as e:
        raise Input(str(e)) from e


class Engine:
    """The stored contracts and what can be asked of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, storage_path(root).rstrip("/")
        self.records, self.businesses = Snapshot(spark, f"{self.root}/contract_records"), Snapshot(spark, f"{self.root}/businesses")
        self.runs_path, self.logs_path = f"{self.root}/import_runs", f"{self.root}/enrichment_logs"

    def init(self) -> list[str]:
        """Makes the tables that are not there yet, without rows; returns their names."""
        missing = [name for name, t in (("contract_records", self.records), ("businesses", self.businesses)) if not t.version()]
        if missing:
            # Both tables are written by one merge of no rows, which leaves rows that are there as they are.
            self._stored(self.spark.createDataFrame([], "source_dataset string, source_row_hash string, biz_no_normalized string, biz_no_display string"), "csv")
        return missing

    def _stored(self, rows: DataFrame, run: str) -> dict[str, int]:
        """Merges canonical rows: records by their hash, businesses by number and source priority."""
        now = F.current_timestamp()
        columns = {"source_dataset": "string", "source_row_hash": "string", "biz_no_normalized": "string", "biz_no_display": "string", **{n: "bigint" if n.endswith("_amount") else "string" for n in (*REQUIRED[1:], *OPTIONAL)}}
        rows = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()))
        new = rows.withColumn("_place", F.monotonically_increasing_id())
        keyed = new.withColumns({"business_id": F.sha2("biz_no_normalized", 256), "source_status": F.lit("local_only"), "created_at": now, "updated_at": now}).withColumn("id", F.sha2(F.concat_ws(":", *RECORD_KEYS), 256))
        old = self.records.read() if self.records.version() else keyed.drop("_place").limit(0)
        counts = merge.upsert_counts(old, keyed, RECORD_KEYS).first().asDict()
        kept = ["source_status", "created_at", "id"]
        self.records.write(merge.upsert(old, keyed, RECORD_KEYS, "_place", kept, {"source_status": F.lit("local_only"), "created_at": now, "id": F.sha2(F.concat_ws(":", *(F.coalesce(f"s.{k}", f"t.{k}") for k in RECORD_KEYS)), 256)}))
        profiles = new.select(F.col("biz_no_normalized").alias("biz_no"), *(F.col(c) if c in new.columns else F.lit(None).cast("string").alias(c) for c in PROFILE), F.lit(run).alias("profile_source"), "_place")
        have = self.businesses.read() if self.businesses.version() else profiles.drop("_place").limit(0)
        self.businesses.write(merge.merge_profiles(have, profiles, "biz_no", PROFILE, "_place"))
        return counts

    def import_index(self, path: str) -> dict[str, object]:
        """Reads a contract index; returns counters. Bad lines are counted and never stored."""
        rows, errors = read_index(self.spark, path)
        n_errors = errors.count()
        counts = self._stored(rows, "csv") | {"errors": n_errors}
        state = self._state(counts)
        run = self.spark.createDataFrame([(path, counts["inserted"], counts["updated"], n_errors, datetime.now(UTC), state)], RUN)
        merge.append(run, self.runs_path)
        return counts | {"status": state}

    def store_pages(self, items: DataFrame, numbers: str) -> dict[str, int]:
        """Canonical rows of provider items (a column ``row``) for the requested numbers."""
        asked = self.spark.createDataFrame([(n,) for n in parse_numbers(numbers)], "biz_no string")
        rows, failures = mappers.lookup_rows(items, asked)
        return self._stored(rows.withColumn("contract_date", F.col("contract_date").cast("string")), "provider") | {"skipped": failures.count()}

    def sync(self, numbers: str, date_from: date, date_to: date, category: str | None, fetch) -> dict[str, object]:
        """Collects what ``fetch(source, window, category)``, a list of pages, has for the numbers; returns counters and a status.

        Each source that the category needs is asked by months, a month that is too large (ValueError) by weeks and days. Where every
        window of the standard source refuses the key (Unauthorized), the source of contract information is asked by category
        instead. Rows are stored and an audit row is written for each source; errors of a window do not end the others.
        """
        asked = self.spark.createDataFrame([(n,) for n in parse_numbers(numbers)], "biz_no string")
        windows, total = sync.months(date_from, date_to), dict.fromkeys(sync.COUNTERS, 0)
        for source in sync.sources(category):
            pages, errors = sync.fetch_all(windows, lambda w, s=source: fetch(s, w, None))
            if source == "standard" and sync.unauthorized_only(len(pages), errors):
                source, pages, errors = "contract-info", [], []
                for c in [category] if category in sync.CATEGORIES else sync.CATEGORIES:
                    found, failed = sync.fetch_all(windows, lambda w, c=c: fetch("contract-info", w, c))
                    pages, errors = pages + found, errors + failed
            counts = self._collected(source, [p for some in pages for p in some], len(errors), asked, (date_from, date_to), category)
            run = self.spark.createDataFrame([(source, counts["inserted"], counts["updated"], counts["errors"], datetime.now(UTC), self._state(counts))], RUN)
            merge.append(run, self.runs_path)
            total = {k: total[k] + counts[k] for k in total}
        return total | {"status": self._state(total)}

    @staticmethod
    def _state(counts: dict[str, int]) -> str:
        return "success" if not counts["errors"] else "failed" if not counts["inserted"] + counts["updated"] else "partial"

    def _collected(self, source: str, pages: list[str], errors: int, asked: DataFrame, span: tuple[date, date], category: str | None) -> dict[str, int]:
        table = self.spark.createDataFrame(list(enumerate(pages)), "page_no int, page string")
        bad = envelope.parsed_pages(table).where("error is not null").count()
        items, item = envelope.exploded(table), ("page_no", "item_no")
        if source == "shopping":
            rows = mappers.delivery_details(items, asked, carry=item).where(F.col("contract_date").between(*map(F.lit, span)))
        else:
            rows, _ = mappers.lookup_rows(items, asked, carry=item)
            if source == "standard" and category in sync.CATEGORIES:
                rows = rows.where(F.col("business_category") == category)
        counts = sync.item_counts(items, rows, list(item)).first().asDict()
        return counts | self._stored(rows, source) | {"pages": len(pages), "errors": errors + bad}

    def logs(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.logs_path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def search(self, numbers: str, date_from: date | None = None, date_to: date | None = None, category: str | None = None) -> DataFrame:
        """Contracts in the order of the request, newest first, with the business's name and the latest log."""
        records = self.records.read().drop("business_name", "biz_no_display")
        names = self.businesses.read().select(F.sha2("biz_no", 256).alias("id"), "business_name", F.concat_ws("-", F.substring("biz_no", 1, 3), F.substring("biz_no", 4, 2), F.substring("biz_no", 6, 5)).alias("biz_no_display"))
        return search.Search(self.spark, records, names, self.logs()).rows(numbers, date_from, date_to, category)

    def summary(self, found: DataFrame) -> DataFrame:
        linked = F.col("notice_no").isNotNull() | F.col("notice_detail_url").isNotNull()
        return search.summary(found, F.col("total_contract_amount"), F.col("current_contract_amount"), linked, "contract_date")

    flags = staticmethod(runs.flags)

    def health(self) -> DataFrame:
        return search.health(self.records.read(), self.spark.read.parquet(self.runs_path), "finished_at")

    def export(self, path: str, numbers: str, **filters) -> str:
        """Writes the search as CSV into ``path``; returns the file's name for the user."""
        export.write_csv(self.search(numbers, **filters), path, ["place", "position"])
        return export.file_name(parse_numbers(numbers))

    def enrich(self, found: DataFrame, fields: list[str]) -> None:
        """Values found for records (id, fields and perhaps response_status and error_message) replace theirs unless null; each answer is logged."""
        self.records.write(merge.enrich(self.records.read(), found, "id", fields))
        given = lambda c, other: (F.col(c) if c in found.columns else other).cast("string").alias(c)
        last = self.logs().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        merge.append(found.select((F.monotonically_increasing_id() + last + 1).alias("id"), F.col("id").alias("contract_record_id"), F.current_timestamp().cast("string").alias("created_at"), given("response_status", F.lit("success")), given("error_message", F.lit(None))), self.logs_path)

    def enrich_from(self, notices: DataFrame, contracts: DataFrame, bids: DataFrame, fields: list[str]) -> None:
        """Looks records up by notice, contract and unified number and stores what is found. A contract number goes before a unified one."""
        records = self.records.read().select("id", "notice_no", "contract_no", "unified_contract_no")
        found = sync.enrich_lookups(records, notices, contracts, bids)
        self.enrich(found.select("id", *(F.coalesce(*(x for x in (F.col(f) if f in notices.columns else None, F.col("contract")[f] if f in contracts.columns else None) if x is not None)).alias(f) for f in fields)), fields)


def sales_rows(items: DataFrame, period: dates.Period, suppliers: DataFrame) -> DataFrame:
    """Provider items -> attributed rows of the latest versions, one a contract and registered supplier, that began in the period."""
    p = mappers.projections(items)
    latest = versions.latest_with_ties(p, "contract_group", "amendment_order", "contract_date")
    each = versions.expand_suppliers(latest.select("contract_group", "contract_no", "contract_name", "contract_type", "demand_agency_name", "contract_date", "original_contract_date", "amendment_order", "item_codes", "current_contract_amount", "total_contract_amount", "suppliers"))
    split = attribution.attribute(each, ["contract_group", "contract_date", "amendment_order", "total_contract_amount"], "position", "total_contract_amount", "current_contract_amount")
    mine = versions.of_requested(split, suppliers.select("biz_no"))
    inside = overview.origin_in_period(F.col("original_contract_date"), F.col("amendment_order"), F.col("contract_date"), F.col("contract_no"), period)
    key = overview_identity(F.col("contract_no"), F.col("contract_name"), F.col("demand_agency_name"), F.col("original_contract_date"), F.col("contract_date"))
    return mine.where(inside).select(key.alias("contract"), F.col("biz_no").alias("supplier"), F.col("amendment_order").alias("ord"), F.col("contract_date").alias("date"), F.col("total_contract_amount").alias("total"), F.col("attributed_total").alias("amount"), "contract_name", "contract_type", "demand_agency_name", "item_codes", "kind")


def delivery_rows(items: DataFrame, period: dates.Period, suppliers: DataFrame) -> DataFrame:
    """Final deliveries of the target product in the period, in the form of ``sales_rows``."""
    d = mappers.product_deliveries(items, suppliers, TARGET_ITEM_CODE).where(F.col("contract_date").between(F.lit(period.date_from), F.lit(period.date_to)))
    key = overview_identity(F.col("contract_no"), F.col("contract_name"), F.col("demand_agency_name"), F.lit(None).cast("string"), F.col("contract_date").cast("string"))
    return d.select(key.alias("contract"), F.col("biz_no").alias("supplier"), F.lit(None).cast("int").alias("ord"), F.col("contract_date").cast("string").alias("date"), F.col("total_contract_amount").alias("total"), F.col("total_contract_amount").cast("double").alias("amount"), "contract_name", "contract_type", "demand_agency_name", "item_codes", F.lit("full-contract").alias("kind"), F.lit(False).alias("standard"))


def sales_overview(spark: SparkSession, items: DataFrame, period: dates.Period, deliveries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, overall, contracts) of the registry for a period, from the contract source's items and the delivery source's."""
    known = registry(spark).select(F.col("biz_no").alias("supplier"), "biz_no", "name", "display_order")
    rows = sales_rows(items, period, known).withColumn("standard", F.lit(True))
    if deliveries is not None:
        rows = rows.unionByName(delivery_rows(deliveries, period, known), allowMissingColumns=True)
    ceiling = overview.master_ceiling(F.col("standard"), F.col("contract_type"), F.col("contract_name"), F.col("demand_agency_name"))
    sales = overview.registry_sales(rows, known, overview.related(item_codes("item_codes"), ceiling), [F.col("contract_name").desc()])
    return overview.companies(sales, known), overview.overall(sales, "total"), sales
