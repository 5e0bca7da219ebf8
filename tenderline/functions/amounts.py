"""Amounts: four ways in, one rounding, and the split of a contract's amount over its suppliers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty, trimmed

SAFE = 9_007_199_254_740_991


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(c.cast("double") + 0.5).cast("long")


def won(c: Column) -> Column:
    """Commas and white space dropped, rounded; blank or malformed is null."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[,\s]", "")
    return F.when(plain != "", rounded(F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))))


def amount_strict(c: Column, suffix: bool = True) -> Column:
    """Unsigned digits, grouped by commas or not, with the currency's sign after or not; else null."""
    text = trimmed(c)
    ok = text.rlike(r"^(\d+|\d{1,3}(,\d{3})+)" + (r"(?U)\s*원?$" if suffix else "$"))
    return F.when(ok, F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"))


def amount_loose(c: Column) -> Column:
    """All but digits, dots and dashes dropped; what is no number is 0."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d.-]", "")
    return F.coalesce(F.when(text.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), text.try_cast("double")), F.lit(0.0))


def amount_signed(c: Column) -> Column:
    """A signed decimal, commas dropped, rounded; else null."""
    text = F.replace(trimmed(c), F.lit(","), F.lit(""))
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), rounded(text.try_cast("double")))


def amount_unsigned(c: Column) -> Column:
    """An unsigned decimal, commas dropped, rounded, within the whole numbers a double holds; else null."""
    text = F.replace(text_or_empty(c), F.lit(","), F.lit(""))
    value = rounded(text.try_cast("double"))
    return F.when(text.rlike(r"^\d+(\.\d+)?$") & (value <= SAFE), value)


def delivery_amount(direct: Column, change: Column) -> Column:
    """The amount unless it is missing or 0, then the change, then the amount."""
    a, b = amount_signed(direct), amount_signed(change)
    return F.when(a != 0, a).otherwise(F.coalesce(b, a))


def whole_number(c: Column) -> Column:
    """Digits only, within the whole numbers a double holds; else null."""
    value = c.try_cast("bigint")
    return F.when(c.rlike(r"^\d+$") & (value <= SAFE), value)


def first_non_negative(row: Column, keys: list[str]) -> Column:
    """The first number of a map column under ``keys`` that is readable and not negative."""

    def one(c):
        text = text_or_empty(c)
        plain = F.regexp_replace(text, r"[^\d.-]", "")
        value = F.when(plain == "", F.lit(0.0)).when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
        return F.when((text != "") & (value >= 0), value)

    return F.coalesce(*(one(row[k]) for k in keys))
