"""The split of a contract's amounts over its suppliers: one row a supplier in and out, one shuffle by contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import rounded

#: Shares are whole in units of a millionth of a percent.
RATE_UNIT = 1_000_000
_WIDE = "decimal(38,0)"


def allocate(rows: DataFrame, keys: list[str], position: str, amount: str, weight: str, out: str) -> DataFrame:
    """Splits a whole amount by whole weights: floors, then one unit each by the largest remainder, the first position on ties.

    Whole-number arithmetic, so no float error moves a unit. Without a positive weight all parts are 0.
    """
    by = Window.partitionBy(*keys)
    r = rows.withColumn("_tw", F.nullif(F.sum(weight).over(by), F.lit(0)).cast(_WIDE))
    r = r.withColumn("_p", (F.col(amount).cast("decimal(19,0)") * F.col(weight).cast("decimal(18,0)")).cast(_WIDE))
    r = r.withColumn("_rest", F.pmod("_p", "_tw")).withColumn("_base", F.expr("(_p - _rest) div _tw"))
    r = r.withColumn("_left", F.col(amount).cast("long") - F.sum("_base").over(by)).withColumn("_k", F.row_number().over(by.orderBy(F.col("_rest").desc(), F.col(position))))
    part = F.coalesce(F.col("_base") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0), F.lit(0))
    return r.withColumn(out, part.cast("long")).drop("_tw", "_p", "_rest", "_base", "_left", "_k")


def attribute(rows: DataFrame, keys: list[str], position: str, total: str, current: str, amount: str = "amount", rate: str = "rate") -> DataFrame:
    """Rows with attributed_total, attributed_current and kind.

    All amounts known and together within the total: as reported, the current amount in proportion. All rates known, each at
    most 100, together 100 within 0.001: by rate. Else the whole to one supplier, or equal shares. Fractional amounts are split
    in proportion, the rest of the sum to the first.
    """
    by = Window.partitionBy(*keys)
    value = {"_t": F.coalesce(F.col(total), F.lit(0)).cast("double"), "_c": F.coalesce(F.col(current), F.lit(0)).cast("double")}
    units = rounded(F.col(rate) * RATE_UNIT)
    r = rows.withColumns({**value, "_u": units})
    # All sums that do not depend on the kind in one pass over the contract's rows.
    r = r.withColumns({
        "_n": F.count("*").over(by), "_na": F.count(amount).over(by), "_sa": F.sum(amount).over(by), "_nr": F.count(rate).over(by), "_mr": F.max(rate).over(by), "_sr": F.sum(rate).over(by), "_su": F.sum("_u").over(by),
        "_first": F.min(position).over(by),
    })
    by_amount = F.coalesce((F.col("_na") == F.col("_n")) & (F.col("_sa") <= F.col("_t")), F.lit(False))
    by_rate = F.coalesce((F.col("_nr") == F.col("_n")) & (F.col("_mr") <= 100) & (F.abs(F.col("_sr") - 100) < 0.001), F.lit(False))
    kind = F.when(by_amount, "supplier-reported").when(by_rate, "supplier-rate").when(F.col("_n") == 1, "full-contract").otherwise("equal-share")
    r = r.withColumn("kind", kind)
    rated = F.col("kind") == "supplier-rate"
    r = r.withColumns({"_w": F.when(rated, F.col("_u")).otherwise(F.lit(1).cast("long")), "_tw": F.nullif(F.when(rated, F.col("_su")).otherwise(F.col("_n")), F.lit(0))})
    for v in value:
        r = r.withColumn(f"{v}p", (F.floor(v).cast("decimal(19,0)") * F.col("_w").cast("decimal(18,0)")).cast(_WIDE))
        r = r.withColumn(f"{v}rest", F.pmod(f"{v}p", F.col("_tw").cast(_WIDE))).withColumn(f"{v}base", F.expr(f"({v}p - {v}rest) div _tw"))
        r = r.withColumn(f"{v}share", F.col(v) * F.col("_w") / F.col("_tw"))
    r = r.withColumns({f"{v}sum{x}": F.sum(f"{v}{x}").over(by) for v in value for x in ("base", "share")})
    r = r.withColumns({f"{v}k": F.row_number().over(by.orderBy(F.col(f"{v}rest").desc(), F.col(position))) for v in value})
    part = {}
    for v in value:
        whole = F.coalesce(F.col(f"{v}base") + F.when(F.col(f"{v}k") <= F.floor(v) - F.col(f"{v}sumbase"), 1).otherwise(0), F.lit(0)).cast("double")
        exact = F.col(f"{v}share") + F.when(F.col(position) == F.col("_first"), F.col(v) - F.col(f"{v}sumshare")).otherwise(0.0)
        part[v] = F.when(F.col(v) == F.floor(v), whole).otherwise(exact)
    known = F.col("kind") == "supplier-reported"
    reported = F.when(F.col("_t") > 0, F.col("_c") * F.col(amount) / F.col("_t")).otherwise(0.0)
    r = r.withColumns({"attributed_total": F.when(known, F.col(amount)).otherwise(part["_t"]), "attributed_current": F.when(known, reported).otherwise(part["_c"])})
    return r.select(*rows.columns, "attributed_total", "attributed_current", "kind")
