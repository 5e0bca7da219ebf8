"""Text expressions. All are built in, but for NFKC, which Spark lacks: one Arrow UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_EDGE = r"(?U)^[\s﻿]+|[\s﻿]+$"


def trimmed(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, _EDGE, "")


def non_blank(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(trimmed(c), F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit(""))


def first_non_blank(row: Column, keys: list[str], fragments: list[str] | None = None) -> Column:
    """The first non-blank value of a map column under ``keys``, else under a key that holds one of ``fragments``, in the map's order."""
    found = [non_blank(row[k]) for k in keys]
    if fragments:
        hits = F.filter(F.map_entries(row), lambda e: F.reduce(F.array(*(F.contains(e["key"], F.lit(f)) for f in fragments)), F.lit(False), lambda a, b: a | b) & non_blank(e["value"]).isNotNull())
        found.append(non_blank(F.try_element_at(hits, F.lit(1))["value"]))
    return F.coalesce(*found) if len(found) > 1 else found[0]


def first_text(row: Column, keys: list[str], default: str = "") -> Column:
    """Like ``first_non_blank``, with a default instead of null."""
    return F.coalesce(first_non_blank(row, keys), F.lit(default))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def business_number(c: Column) -> Column:
    """Ten digits, or null."""
    return F.when(F.length(digits(c)) == 10, digits(c))


def strict_business_number(c: Column) -> Column:
    """Ten digits, or an error."""
    return F.coalesce(business_number(c), F.raise_error(F.lit("biz_no must contain 10 digits")).cast("string"))


def display_number(c: Column) -> Column:
    """3-2-5."""
    return F.concat_ws("-", F.substring(c, 1, 3), F.substring(c, 4, 2), F.substring(c, 6, 20))


#: Business numbers of one request, at most.
MOST_NUMBERS = 50


def parse_numbers(text: str, most: int | None = MOST_NUMBERS) -> list[str]:
    """A request's distinct business numbers in order; raises on a malformed or missing one or too many."""
    parts = [re.sub(r"[^0-9]", "", x) for x in re.split(r"[,\s/]+", text) if x.strip()]
    if not parts or any(len(x) != 10 for x in parts):
        raise ValueError("each business number must contain 10 digits")
    out = list(dict.fromkeys(parts))
    if most is not None and len(out) > most:
        raise ValueError(f"at most {most} business numbers")
    return out


def number_list(c: Column) -> Column:
    """The distinct valid business numbers of a text column, in order."""
    return F.array_distinct(F.array_compact(F.transform(F.split(c, r"(?U)[,\s/]+"), business_number)))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def canonical_text(c: Column) -> Column:
    """NFKC, trimmed, white space collapsed, lower case; null is empty."""
    return F.lower(F.regexp_replace(text_or_empty(nfkc(c)), r"(?U)\s+", " "))


def compact_text(c: Column) -> Column:
    """NFKC without white space; null is empty."""
    return F.regexp_replace(F.coalesce(nfkc(c), F.lit("")), r"(?U)[\s﻿]+", "")


def bracket_entries(c: Column) -> Column:
    """The contents of ``[...]`` groups, or the whole text where there is none; an array of trimmed ``^`` fields each."""
    text = text_or_empty(c)
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    entries = F.when(text == "", F.array().cast("array<string>")).when(F.size(groups) > 0, groups).otherwise(F.array(text))
    return F.transform(entries, lambda e: F.transform(F.split(e, r"\^"), trimmed))


def supplier_list(c: Column) -> Column:
    """Suppliers of a list text: field 4 is the name, 5 the representative, the last field of ten digits the number; those without a number fall away."""

    def one(parts: Column) -> Column:
        numbers = F.filter(F.transform(parts, digits), lambda d: F.length(d) == 10)
        field = lambda k: F.nullif(F.get(parts, F.lit(k)), F.lit(""))
        return F.struct(field(3).alias("name"), field(4).alias("representative"), F.try_element_at(numbers, F.lit(-1)).alias("biz_no"))

    return F.filter(F.transform(bracket_entries(c), one), lambda s: s["biz_no"].isNotNull())


def first_agency(c: Column) -> Column:
    """(code, name) of the first entry of an agency list."""
    parts = F.get(bracket_entries(c), F.lit(0))
    return F.struct(F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("code"), F.nullif(F.get(parts, F.lit(2)), F.lit("")).alias("name"))


def query_value(url: Column, key: str, default: str | None = None) -> Column:
    """A query parameter, decoded; null or the default where it is missing or the URL can't be read."""
    found = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))
    return found if default is None else F.coalesce(found, F.lit(default))


def safe_url(c: Column) -> Column:
    """The URL if it is http or https."""
    return F.when(F.lower(F.try_parse_url(trimmed(c), F.lit("PROTOCOL"))).isin("http", "https"), trimmed(c))


def redacted(c: Column, key: str = "serviceKey") -> Column:
    """Values of a key parameter hidden, in URLs and messages."""
    return F.regexp_replace(c, rf"(?i)({re.escape(key)}=)[^&\s]+", "$1[REDACTED]")


def without_secrets(c: Column) -> Column:
    """Quoted values that are assigned to tokens, secrets, passwords and keys hidden."""
    return F.regexp_replace(c, r'(?i)(token|secret|password|key)(\s*[=:]\s*)"[^"]*"', '$1$2"[REDACTED]"')


def csv_field(c: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def signals(text: Column, terms: list[tuple[str, str]]) -> Column:
    """Labels of the terms that a text holds, in the terms' order."""
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(t)), F.lit(label)) for t, label in terms)))


# Terms that tell building control from process control.
POSITIVE_TERMS = [("빌딩자동제어", "빌딩자동제어"), ("건물자동제어", "건물자동제어"), ("bems", "BEMS"), ("빌딩에너지관리", "빌딩에너지관리"), ("건물에너지관리", "건물에너지관리")]
CONFLICTING_TERMS = [(t, t) for t in ("정수장", "상수", "하수", "오수", "계장제어", "공정제어", "취수장", "배수지", "펌프장")]
CONTEXT_TERMS = ["빌딩", "건물", "청사", "학교", "교사동", "공조", "냉난방", "기계설비", "중앙감시", "체육관", "도서관", "병원"]


def control_signals(name: Column) -> Column:
    """(related, positive, conflicting) of a contract's name."""
    text = F.lower(compact_text(name))
    positive, conflicting = signals(text, POSITIVE_TERMS), signals(text, CONFLICTING_TERMS)
    near = F.size(signals(text, [(t, t) for t in CONTEXT_TERMS])) > 0
    positive = F.when((F.size(positive) == 0) & F.contains(text, F.lit("자동제어")) & near, F.array(F.lit("건물시설 자동제어"))).otherwise(positive)
    return F.struct(((F.size(positive) > 0) & (F.size(conflicting) == 0)).alias("related"), positive.alias("positive"), conflicting.alias("conflicting"))


def error_kind(message: Column) -> Column:
    """unauthorized, date_range_too_large or other, by the provider's message."""
    return F.when(message.rlike(r"(?i)service ?key|not registered|unauthori[sz]ed|forbidden|access denied|인증|권한"), "unauthorized").when(message.rlike(r"(?i)date.*(range|exceed)|range.*date|기간|조회.*초과"), "date_range_too_large").otherwise("other")


def compact_date_input(c: Column) -> Column:
    """Digits of a date as typed, with dashes after the fourth and sixth."""
    d = F.substring(digits(c), 1, 8)
    return F.when(F.length(d) <= 4, d).when(F.length(d) <= 6, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2))).otherwise(F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


# Spellings of the business categories.
CATEGORIES = {"goods": "goods", "물품": "goods", "construction": "construction", "공사": "construction", "services": "services", "service": "services", "용역": "services", "foreign": "foreign", "외자": "foreign"}


def category(c: Column) -> Column:
    """One of four codes, unknown for any other text, null for null."""
    key = F.lower(trimmed(c))
    out = F.lit("unknown")
    for spelling, code in CATEGORIES.items():
        out = F.when(key == spelling, code).otherwise(out)
    return F.when(c.isNotNull(), out)
