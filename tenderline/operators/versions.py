"""Which version of a contract counts.

A missing order or date sorts below any other, but is only the same version as another missing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(order: str, date: str, *more) -> list:
    return [F.coalesce(F.col(order), F.lit(-1)).desc(), F.col(date).desc_nulls_last(), *more]


def latest_with_ties(rows: DataFrame, key: str, order: str, date: str, keep: Column | None = None) -> DataFrame:
    """All rows at the greatest (order, date) of their key. ``keep``: only keys with a row of any version for which it holds.

    The keys' rows are ranked before suppliers are asked for: a newer version without the supplier still ends the older one.
    """
    by = Window.partitionBy(key)
    ranked = rows.withColumn("_rank", F.rank().over(by.orderBy(*_newest(order, date))))
    # Rank goes by the coalesced order; a row with order -1 and one without share it but are different versions.
    ranked = ranked.withColumn("_own", F.first(F.struct(order)).over(by.orderBy(*_newest(order, date), F.col(order).desc_nulls_last())))
    if keep is not None:
        ranked = ranked.withColumn("_keep", F.max(F.coalesce(keep, F.lit(False))).over(by)).where("_keep").drop("_keep")
    return ranked.where((F.col("_rank") == 1) & F.col(order).eqNullSafe(F.col("_own")[order])).drop("_rank", "_own")


def latest_single(rows: DataFrame, key: str, order: str, date: str, tie: list) -> DataFrame:
    """One row a key: the greatest (order, date), then by ``tie``."""
    w = Window.partitionBy(key).orderBy(*_newest(order, date, *tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def original_first(rows: DataFrame, key: str, order: str, date: str, total: str) -> DataFrame:
    """Of each key, the originals (order 0 or missing) if there are any, else all; of these the rows of the newest version.

    A version is (order, date, total), null-safe; the total breaks ties of order and date.
    """
    is_original = F.coalesce(F.col(order), F.lit(0)) == 0
    some = rows.withColumn("_any", F.max(is_original).over(Window.partitionBy(key))).where(is_original | ~F.col("_any")).drop("_any")
    return newest_equal(some, key, order, date, total)


def newest_equal(rows: DataFrame, key: str, order: str, date: str, total: str) -> DataFrame:
    """The rows of each key whose (order, date, total) is that of its newest row, the greatest total on ties; null-safe."""
    best = Window.partitionBy(key).orderBy(*_newest(order, date, F.col(total).desc_nulls_last()))
    top = rows.withColumn("_v", F.first(F.struct(F.col(order).alias("o"), F.col(date).alias("d"), F.col(total).alias("t"))).over(best))
    same = F.col(order).eqNullSafe(F.col("_v.o")) & F.col(date).eqNullSafe(F.col("_v.d")) & F.col(total).eqNullSafe(F.col("_v.t"))
    return top.where(same).drop("_v")


def representative(rows: DataFrame, keys: list[str], order: str, date: str, amount: str, tie: list) -> DataFrame:
    """One row for each key combination: the newest, then the largest amount. Further lines of a delivery request are not added up."""
    w = Window.partitionBy(*keys).orderBy(*_newest(order, date, F.col(amount).desc_nulls_last(), *tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_suppliers(suppliers: Column) -> Column:
    """One supplier a number in order of appearance, with the first name that is not empty."""
    numbers = F.array_distinct(F.transform(suppliers, lambda s: s["biz_no"]))

    def one(n):
        own = F.filter(suppliers, lambda s: s["biz_no"] == n)
        named = F.filter(own, lambda s: F.coalesce(s["name"], F.lit("")) != "")
        return F.when(F.size(named) > 0, F.get(named, F.lit(0))).otherwise(F.get(own, F.lit(0)))

    return F.transform(numbers, one)


def distinct_suppliers(suppliers: Column) -> Column:
    """By number and name."""
    return F.array_distinct(F.transform(suppliers, lambda s: F.struct(s["biz_no"].alias("biz_no"), s["name"].alias("name"))))


def expand_suppliers(contracts: DataFrame, suppliers: str = "suppliers") -> DataFrame:
    """One row for each contract and distinct supplier number: position, biz_no, name, amount, rate beside the contract's columns."""
    one = contracts.withColumn(suppliers, unique_suppliers(F.col(suppliers)))
    rest = [c for c in contracts.columns if c != suppliers]
    return one.select(*rest, F.posexplode(suppliers).alias("position", "_s")).select(*rest, "position", "_s.*")


def of_requested(rows: DataFrame, requested: DataFrame, supplier: str = "biz_no") -> DataFrame:
    """Rows of requested suppliers, after the split over all of a contract's suppliers. The request is a small list."""
    return rows.join(requested.select(supplier).distinct(), supplier, "left_semi")


def drop_superseded(cached: DataFrame, latest: DataFrame, key: str, order: str, date: str, supplier: str, suppliers: str) -> DataFrame:
    """Cached rows without those whose key has a newer fetched version, or an equal one that no longer holds the supplier."""
    new = latest.select(F.col(key).alias("_key"), F.coalesce(order, F.lit(-1)).alias("_o"), F.coalesce(F.col(date).cast("string"), F.lit("")).alias("_d"), F.col(suppliers).alias("_s"))
    o, d = F.coalesce(F.col(order), F.lit(-1)), F.coalesce(F.col(date).cast("string"), F.lit(""))
    newer = F.when(F.col("_o") != o, F.col("_o") > o).when(F.col("_d") != d, F.col("_d") > d).otherwise(~F.array_contains("_s", F.col(supplier)))
    return cached.join(new, F.col(key) == F.col("_key"), "left").where(F.col("_key").isNull() | ~newer).drop("_key", "_o", "_d", "_s")


def removed_suppliers(latest: DataFrame, key: str, has_requested: Column, known: DataFrame) -> DataFrame:
    """Known keys whose latest rows hold no requested supplier any more."""
    return latest.groupBy(key).agg(F.max(has_requested).alias("held")).where("not held").join(known.select(key).distinct(), key, "left_semi").select(key)


def dedupe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One of the rows that are equal in ``columns``. The columns themselves are the keys, so no text is made and hashed of them."""
    return rows.dropDuplicates(columns)
