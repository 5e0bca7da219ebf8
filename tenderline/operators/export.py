"""Exports: the contract list as CSV, the sales overview as two sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, safe_url

# The header of the export, in order.
HEADER = ["사업자등록번호", "업체명", "계약일", "계약명", "공고명", "계약금액", "수요기관", "계약기관", "계약방법", "업무구분", "공고번호", "계약번호", "계약상세URL", "공고상세URL", "데이터상태"]
BOM = "﻿"
ATTRIBUTION = {"supplier-reported": "업체별 금액", "supplier-rate": "지분율", "full-contract": "단독", "equal-share": "균등 추정"}


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *(csv_field(c) for c in columns))


def contract_lines(rows: DataFrame) -> DataFrame:
    """Lines of the export in the order of the rows' place and position, with ``line``."""
    amount = F.coalesce("total_contract_amount", "current_contract_amount")
    columns = [F.coalesce("biz_no_display", "biz_no_normalized"), *map(F.col, ("business_name", "contract_date", "contract_name", "notice_name")), amount, *map(F.col, ("demand_agency_name", "contract_agency_name", "contract_method", "business_category", "notice_no", "contract_no", "contract_detail_url", "notice_detail_url", "source_status"))]
    return rows.select("*", csv_line(columns).alias("line"))


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """One file of a bounded result: mark, header, a line a row, a line end at the end. The path is one that Spark reaches."""
    head = rows.sparkSession.createDataFrame([(0, BOM + ",".join(HEADER))], "part int, line string")
    body = contract_lines(rows).select(F.lit(1).alias("part"), *order, "line")
    whole = head.unionByName(body, allowMissingColumns=True).orderBy("part", *order)
    whole.coalesce(1).select("line").write.mode("overwrite").text(path)


def file_name(numbers: list[str]) -> str:
    return f"contracts-{numbers[0] if len(numbers) == 1 else 'multi'}.csv"


def summary_sheet(ranked: DataFrame) -> DataFrame:
    """rank, company, contract count, total, latest date."""
    return ranked.select("rank", F.col("supplier").alias("company"), "contract_count", "total_amount", "latest_date").orderBy("rank")


def attribution_label(kind: Column) -> Column:
    out = F.coalesce(kind, F.lit("-"))
    for k, label in ATTRIBUTION.items():
        out = F.when(kind == k, label).otherwise(out)
    return out


def detail_sheet(sales: DataFrame, ranked: DataFrame, columns: list[str]) -> DataFrame:
    """The companies' contracts in order of rank, latest and largest first."""
    return sales.join(ranked.select("supplier", "rank"), "supplier").select("rank", "supplier", *columns)


def link(url: Column) -> Column:
    """Only http and https become links."""
    return safe_url(url)


def exportable(complete: bool, fresh: bool) -> None:
    """Raises unless the period is there whole and fresh."""
    if not (complete and fresh):
        raise ValueError("the period is not complete and fresh")
