"""The registry of suppliers, a fixed dimension of 22 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import designation_end

# Name, business number, designation number, first day of the designation, in display order.
SUPPLIERS = [
    ("덕산메카시스(주)", "2208104763", "2026058", "2026-07-20"),
    ("(주)우리젠", "1138190302", "2025208", "2026-01-19"),
    ("이에스콘트롤스(주)", "1108175113", "2025205", "2026-01-19"),
    ("주식회사 비엘아이앤씨", "7708700599", "2025140", "2026-01-18"),
    ("(주)파노텍", "2048145651", "2025135", "2025-10-20"),
    ("중앙아이엔티 주식회사", "1268144518", "2025074", "2025-07-21"),
    ("성한 주식회사", "3148146957", "2025073", "2025-07-21"),
    ("한경기전(주)", "1138111990", "2024064", "2024-09-13"),
    ("한국디지탈콘트롤 주식회사", "1238122892", "2024063", "2024-07-15"),
    ("주식회사 나라컨트롤", "2118138895", "2024150", "2024-07-15"),
    ("주식회사 삼원씨앤지", "2048169430", "2024018", "2024-04-15"),
    ("주식회사 신영정보기술", "2068117262", "2024004", "2024-04-15"),
    ("주식회사일렉콤", "1338128627", "2023197", "2024-01-22"),
    ("(주)헤리트", "3148130305", "2022241", "2023-03-17"),
    ("(주)케이디티", "1078171028", "2022186", "2022-10-24"),
    ("로지시스템(주)", "1098182104", "2022061", "2022-05-02"),
    ("주식회사 엠알바스", "2148143121", "2021037", "2021-06-07"),
    ("주식회사 주인정보시스템", "2208658565", "2020239", "2021-03-22"),
    ("서전엔지니어링(주)", "2208165402", "2020220", "2021-03-22"),
    ("(주)동양이엔씨", "1068133832", "2020111", "2020-11-10"),
    ("(주)신아시스템", "1238180252", "2020101", "2020-11-10"),
    ("화인시스템(주)", "5028142086", "2020059", "2020-07-31"),
]
TARGET_ITEM_CODE = "3912180101"


def registry(spark: SparkSession) -> DataFrame:
    """supplier_id, name, biz_no, designation_no, designation_start, designation_end, item_code, display_order."""
    rows = [(n, b, d, s, k + 1) for k, (n, b, d, s) in enumerate(SUPPLIERS)]
    out = spark.createDataFrame(rows, "name string, biz_no string, designation_no string, designation_start string, display_order int")
    start = F.to_date("designation_start")
    return out.select(
        F.concat(F.lit("excellent-"), "designation_no").alias("supplier_id"), "name", "biz_no", "designation_no",
        start.alias("designation_start"), designation_end(start).alias("designation_end"), F.lit(TARGET_ITEM_CODE).alias("item_code"), "display_order",
    )
