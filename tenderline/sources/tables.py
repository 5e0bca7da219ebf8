"""The supplied tables, and the views that give them the shape of contracts.

contract = order; version = line number less one (0 is the original) and ship year; supplier = l_suppkey; registry = the
suppliers below 22; attributed amount and contract total = rounded prices; item code = part type; agency = customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import rounded

REGISTRY_SIZE = 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line: contract, supplier, ord, yr, amount, part, ship."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("contract"), F.col("l_suppkey").alias("supplier"), (F.col("l_linenumber") - 1).alias("ord"), F.year("l_shipdate").alias("yr"),
        rounded(F.col("l_extendedprice")).alias("amount"), F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("ship"),
    )


def contracts(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """One row an order: contract, ceiling, signed (date), agency (customer key). The year is a range of the stored column, so it reaches the scan."""
    rows = table(spark, sf_dir, "orders")
    if year is not None:
        edge = lambda y: F.lit(f"{y}-01-01").cast(rows.schema["o_orderdate"].dataType)
        rows = rows.where((F.col("o_orderdate") >= edge(year)) & (F.col("o_orderdate") < edge(year + 1)))
    return rows.select(F.col("o_orderkey").alias("contract"), rounded(F.col("o_totalprice")).alias("ceiling"), F.to_date("o_orderdate").alias("signed"), F.col("o_custkey").alias("agency"))


def registry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, display_order: the registry's rows, a fixed number."""
    s = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") < REGISTRY_SIZE)
    return s.select(F.col("s_suppkey").alias("supplier"), F.col("s_suppkey").alias("display_order"))
