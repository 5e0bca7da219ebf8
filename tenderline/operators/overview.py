"""Sales overview of the registry's suppliers for a period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import Period
from ..functions.identity import item_codes
from ..functions.text import compact_text
from ..sources.registry import TARGET_ITEM_CODE
from .versions import original_first, representative


def origin_in_period(original_date: Column, order: Column, date: Column, contract_no: Column, period: Period) -> Column:
    """Whether a contract began in the period: by its original date; an original by its own date (none passes); an amendment by the year in its number (none passes)."""
    a, b = str(period.date_from), str(period.date_to)
    inside = lambda c: (c >= a) & (c <= b)
    year = F.regexp_extract(F.coalesce(contract_no, F.lit("")), r"(?i)^R(\d{2})", 1)
    return (
        F.when(F.coalesce(original_date, F.lit("")) != "", inside(original_date))
        .when(F.coalesce(order, F.lit(0)) == 0, F.when(F.coalesce(date, F.lit("")) == "", True).otherwise(inside(date)))
        .when(year == "", True)
        .otherwise(year.try_cast("int") + 2000 == period.year)
    )


# The marks of a unit-price master contract, which only states a ceiling.
UNIT_PRICE, EVERY_AGENCY = "제3자단가계약", "각수요기관"


def master_ceiling(standard_source: Column, contract_type: Column, name: Column, agency: Column) -> Column:
    unit_price = (compact_text(contract_type) == UNIT_PRICE) | F.contains(compact_text(name), F.lit(UNIT_PRICE))
    return standard_source & unit_price & (compact_text(agency) == EVERY_AGENCY)


def related(codes: Column, ceiling: Column) -> Column:
    """Contracts for the target item that are no master ceilings."""
    return ~ceiling & F.array_contains(item_codes(F.coalesce(codes, F.array().cast("array<string>"))), TARGET_ITEM_CODE)


def registry_sales(rows: DataFrame, registry: DataFrame, is_related: Column, tie: list) -> DataFrame:
    """One row for each registered supplier and contract that counts, with source_rows, the rows of any version.

    ``rows`` (contract, supplier, ord, date, amount, total, ...) are those that began in the period. The registry filter comes
    first, then the choice of version, then the item.
    """
    mine = rows.join(F.broadcast(registry.select("supplier")), "supplier", "left_semi")  # the registry has a fixed number of rows
    mine = mine.withColumn("source_rows", F.count("*").over(Window.partitionBy("supplier", "contract")))
    chosen = original_first(mine, "contract", "ord", "date", "total")
    return representative(chosen, ["contract", "supplier"], "ord", "date", "amount", tie).where(is_related)


def companies(sales: DataFrame, registry: DataFrame) -> DataFrame:
    """All of the registry, zero-filled, ranked by total and display order."""
    sums = sales.groupBy("supplier").agg(F.count("*").alias("contract_count"), F.sum("amount").alias("total_amount"), F.max("date").alias("latest_date"))
    all_ = registry.join(sums, "supplier", "left").withColumns({"contract_count": F.coalesce("contract_count", F.lit(0)).cast("long"), "total_amount": F.coalesce("total_amount", F.lit(0)).cast("long")})
    return all_.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total_amount").desc(), "display_order")).cast("long"))


def overall(sales: DataFrame, ceiling: str) -> DataFrame:
    """One row: contracts, the sum of their amounts, each contract's at most its own total, and the latest date."""
    newest = F.max_by(ceiling, F.struct(F.coalesce("ord", F.lit(-1)), F.coalesce(F.col("date").cast("string"), F.lit("")), "amount"))
    each = sales.groupBy("contract").agg(F.sum("amount").alias("a"), newest.alias("c"), F.max("date").alias("d"))
    return each.agg(F.count("*").alias("contract_count"), F.coalesce(F.sum(F.least("a", F.coalesce("c", "a"))), F.lit(0)).cast("long").alias("total_amount"), F.max("d").alias("latest_date"))


def nested(ranked: DataFrame, sales: DataFrame, columns: list[str]) -> DataFrame:
    """The ranked companies with an array of their contracts, latest and largest first."""
    own = sales.groupBy("supplier").agg(F.collect_list(F.struct(F.col("date").alias("_d"), F.col("amount").alias("_a"), *columns)).alias("c"))
    listed = F.transform(F.reverse(F.array_sort("c")), lambda s: F.struct(*(s[c].alias(c) for c in columns)))
    own = own.select("supplier", listed.alias("contracts"))
    none = F.array().cast(own.schema["contracts"].dataType)
    return ranked.join(own, "supplier", "left").withColumn("contracts", F.coalesce("contracts", none))


def estimated(kind: Column) -> Column:
    """Aggregate: whether any of a company's contracts was split in equal shares, so that its total is an estimate."""
    return F.coalesce(F.bool_or(kind == "equal-share"), F.lit(False))


def unavailable(registry: DataFrame, status: str) -> DataFrame:
    """The registry without figures, for a period that is uncollected, being collected or failed."""
    none = lambda kind: F.lit(None).cast(kind)
    return registry.select("*", F.lit(status).alias("collection_status"), none("long").alias("contract_count"), none("long").alias("total_amount"), none("date").alias("latest_date"))
