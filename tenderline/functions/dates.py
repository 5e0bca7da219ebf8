"""Dates: the provider's three spellings, windows over a range, periods in Seoul time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import digits, text_or_empty, trimmed

SEOUL = ZoneInfo("Asia/Seoul")


def _dashed(d: Column) -> Column:
    return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))


def strict_date(c: Column) -> Column:
    """YYYYMMDD, YYYY-MM-DD or YYYY/MM/DD of a real calendar day, as a date; else null."""
    text = trimmed(c)
    return F.when(text.rlike(r"^\d{8}$|^\d{4}[-/]\d{2}[-/]\d{2}$"), F.try_to_date(digits(text), "yyyyMMdd"))


def lenient_date(c: Column) -> Column:
    """Any text of exactly eight digits, as dashed text, calendar day or not; else null."""
    d = digits(text_or_empty(c))
    return F.when(F.length(d) == 8, _dashed(d))


def delivery_date(c: Column) -> Column:
    """Eight digits that are a calendar day, as a date; else null."""
    d = digits(text_or_empty(c))
    return F.when(F.length(d) == 8, F.try_to_date(d, "yyyyMMdd"))


def _windows(rows: DataFrame, step: str, end) -> DataFrame:
    """``rows`` with date_from and date_to -> one row a window: the same columns, window_from, window_to."""
    out = rows.withColumn("_at", F.explode(F.expr(step)))
    return out.withColumn("window_from", F.greatest("_at", "date_from")).withColumn("window_to", F.least(end(F.col("_at")), F.col("date_to"))).drop("_at")


def month_windows(rows: DataFrame) -> DataFrame:
    return _windows(rows, "sequence(trunc(date_from, 'MM'), date_to, interval 1 month)", F.last_day)


def week_windows(rows: DataFrame) -> DataFrame:
    """Seven days each from the first day on."""
    return _windows(rows, "sequence(date_from, date_to, interval 7 day)", lambda c: F.date_add(c, 6))


def day_windows(rows: DataFrame) -> DataFrame:
    return _windows(rows, "sequence(date_from, date_to, interval 1 day)", lambda c: c)


#: The trailing days that are read one by one.
RECENT_DAYS = 14


def hybrid_windows(rows: DataFrame, today: date) -> DataFrame:
    """Weeks up to the day before the trailing days, then days."""
    edge = F.lit(today - timedelta(days=RECENT_DAYS - 1))
    old = rows.where(F.col("date_from") < edge).withColumn("_to", F.col("date_to")).withColumn("date_to", F.least("date_to", F.date_sub(edge, 1)))
    new = rows.where(F.col("date_to") >= edge).withColumn("_from", F.col("date_from")).withColumn("date_from", F.greatest("date_from", edge))
    weeks = week_windows(old).withColumn("date_to", F.col("_to")).drop("_to")
    return weeks.unionByName(day_windows(new).withColumn("date_from", F.col("_from")).drop("_from"))


def recent_window(period_from: Column, period_to: Column) -> Column:
    """First day of a period's trailing days."""
    return F.greatest(F.date_sub(period_to, RECENT_DAYS - 1), period_from)


def seoul_day(ts: Column) -> Column:
    """The calendar day in Seoul of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Seoul"))


def months_between_inclusive(a: Column, b: Column) -> Column:
    return F.greatest((F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a)) + 1, F.lit(1))


def designation_end(start: Column) -> Column:
    """Six years on, less a day; a February 29 stands for March 1 where its year has none."""
    later = F.add_months(start, 72)
    return F.when(F.dayofmonth(start) == F.dayofmonth(later), F.date_sub(later, 1)).otherwise(later)


@dataclass(frozen=True)
class Period:
    kind: str
    year: int
    month: int | None
    quarter: int | None
    date_from: date
    date_to: date

    @property
    def label(self) -> str:
        return f"{self.year}-{self.month:02d}" if self.month else f"{self.year}-Q{self.quarter}" if self.quarter else str(self.year)

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.label}:{self.date_from}:{self.date_to}"


FIRST_YEAR = 2004


def today_in_seoul(now: datetime | None = None) -> date:
    return (now or datetime.now(UTC)).astimezone(SEOUL).date()


def period(kind: str, year: int, month: int | None = None, quarter: int | None = None, now: datetime | None = None) -> Period:
    """A month, quarter or year, cut off at today in Seoul; raises on what does not belong, on unknown years and on the future."""
    given = {"month": month, "quarter": quarter}
    if kind not in ("month", "quarter", "year") or any((given[k] is not None) != (k == kind) for k in given):
        raise ValueError("a period takes its own part only")
    today = today_in_seoul(now)
    if not FIRST_YEAR <= year <= today.year:
        raise ValueError("year out of range")
    if kind == "month" and not 1 <= month <= 12 or kind == "quarter" and not 1 <= quarter <= 4:
        raise ValueError(f"{kind} out of range")
    first, months = (month, 1) if month else (3 * quarter - 2, 3) if quarter else (1, 12)
    start = date(year, first, 1)
    after = date(year + (first + months > 12), (first + months - 1) % 12 + 1, 1)
    if start > today:
        raise ValueError("the period lies in the future")
    return Period(kind, year, month, quarter, start, min(after - timedelta(days=1), today))


def sheet_date(c: Column) -> Column:
    """The day that a text of the form 2026-01-31 names, for a date cell; null for another form, a day that is none, or a year below 100."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
    return F.when(F.year(day) >= 100, day)


def available_years(now: datetime | None = None, first: int = 2020) -> list[int]:
    return list(range(today_in_seoul(now).year, first - 1, -1))
