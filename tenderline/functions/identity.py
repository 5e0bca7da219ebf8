"""Identities: hashes and keys that make equal rows equal. Only the classes of equal rows matter, not the hash values."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import canonical_text, digits, text_or_empty, trimmed

SEPARATOR = "\x1f"


def sha(*parts: Column) -> Column:
    """SHA-256 of parts in order; null parts count as empty, and parts never run into each other."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256)


def row_hash(row: Column) -> Column:
    """SHA-256 of a map's sorted [key, value or empty] pairs as JSON."""
    pairs = F.transform(F.array_sort(F.map_entries(row)), lambda e: F.array(e["key"], F.coalesce(e["value"], F.lit(""))))
    return F.sha2(F.to_json(pairs), 256)


def numbered_row_hash(row: Column, biz_no: Column) -> Column:
    """The hash of a provider's row as seen for one business number."""
    return row_hash(F.map_concat(F.map_filter(row, lambda k, v: k != "__normalizedBizNo"), F.create_map(F.lit("__normalizedBizNo"), biz_no)))


@F.pandas_udf(StringType())
def observation_hash(raw: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with keys sorted at every depth; text that is no JSON is hashed as it is."""

    def one(text):
        if text is None:
            return None
        try:
            text = json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            pass
        return hashlib.sha256(text.encode()).hexdigest()

    return raw.map(one)


def raw_text_hash(raw: Column) -> Column:
    """Sensitive to the order of keys."""
    return F.sha2(raw, 256)


def contract_key(contract_no: Column, notice_no: Column, detail_url: Column, *fallback: Column) -> Column:
    """(kind, key): by contract number, else by notice and detail URL, else by all the other parts. The parts must be canonical."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    kind = F.when(some(contract_no), "contract-no").when(some(notice_no) & some(detail_url), "notice-detail").otherwise("fallback")
    key = F.when(some(contract_no), sha(F.lit("contract-no"), contract_no)).when(some(notice_no) & some(detail_url), sha(F.lit("notice-detail"), notice_no, detail_url)).otherwise(sha(F.lit("fallback"), notice_no, *fallback))
    return F.struct(kind.alias("kind"), key.alias("key"))


def group_key(kind: Column, key: Column, original_date: Column, *parts: Column) -> Column:
    """The key under which versions meet: a fallback with an original date goes by that date and names instead of amounts."""
    return F.when((kind == "fallback") & original_date.isNotNull(), sha(F.lit("fallback-original"), original_date, *parts)).otherwise(key)


def overview_identity(contract_no: Column, name: Column, agency: Column, original_date: Column, date: Column) -> Column:
    """The lower-cased contract number, else name, agency and first known date in canonical form."""
    number = F.lower(text_or_empty(contract_no))
    day = F.coalesce(original_date, date, F.lit(""))
    return F.when(number != "", number).otherwise(F.concat_ws(":", canonical_text(name), canonical_text(agency), canonical_text(day)))


def summary_identity(contract_no: Column, notice_no: Column, detail_url: Column, name: Column, agency: Column, contract_agency: Column, day: Column) -> Column:
    no, notice, url = (canonical_text(c) for c in (contract_no, notice_no, detail_url))
    rest = sha(canonical_text(name), canonical_text(agency), canonical_text(contract_agency), canonical_text(day), url)
    return F.when(no != "", F.concat(F.lit("contract:"), no)).when((notice != "") & (url != ""), F.concat_ws(":", F.lit("notice-detail"), notice, url)).otherwise(F.concat(F.lit("fallback:"), rest))


def notice_identity(notice_no: Column, url: Column) -> Column:
    """By number, else by URL, else null."""
    no, u = canonical_text(notice_no), canonical_text(url)
    return F.when(no != "", F.concat(F.lit("notice:"), no)).when(u != "", F.concat(F.lit("notice-url:"), u))


def delivery_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons; null parts count as empty."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(trimmed(p.cast("string")), F.lit("")) for p in parts)), 256)


def delivery_number(request: Column, change: Column, sequence: Column) -> Column:
    """The parts that are there, joined by dashes."""
    return F.concat_ws("-", request, change, sequence)


def item_code(c: Column) -> Column:
    """Exactly ten digits, or null."""
    return F.when(F.length(digits(c)) == 10, digits(c))


def item_codes(codes: Column) -> Column:
    """Distinct ten-digit codes in order."""
    return F.array_distinct(F.array_compact(F.transform(codes, item_code)))


def merged_codes(a: Column, b: Column) -> Column:
    """The codes of both lists, each once, in order of appearance; a missing list is empty."""
    none = F.array().cast("array<string>")
    return item_codes(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def item_names(*names: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.nullif(text_or_empty(n), F.lit("")) for n in names))))


def registry_key(numbers: Column) -> Column:
    """Sorted distinct numbers, joined."""
    return F.array_join(F.array_sort(F.array_distinct(numbers)), ",")
