"""Text, amount, date and identity expressions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts, dates, identity, text
from ..operators import export
from ..sources import envelope
from ..sources.registry import SUPPLIERS
from ..sources.tables import table

TEXTS = ["물품", " goods ", "공사", "Construction", "용역", "SERVICE", "외자", "foreign", "other", None]


def _variant(key, values):
    """One of some texts by a row's key: every row of the table takes part."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _sql_variant(key, values):
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({key} % {len(values)} + 1)::INT]"


def category_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.category(_variant(F.col("p_partkey"), TEXTS)).alias("category"))


category_normalise.sql = f"""WITH v AS (SELECT p_partkey, lower(trim({_sql_variant('p_partkey', TEXTS)})) AS t FROM part)
SELECT p_partkey, CASE WHEN t IS NULL THEN NULL WHEN t IN ('goods', '물품') THEN 'goods' WHEN t IN ('construction', '공사') THEN 'construction' WHEN t IN ('services', 'service', '용역') THEN 'services'
  WHEN t IN ('foreign', '외자') THEN 'foreign' ELSE 'unknown' END AS category FROM v"""

AMOUNTS = ["1,200,000", "1200000원", "1,23", "-5", "-2.5", "2.5", "1e3", "", " 77 ", None, "9007199254740993", "abc", "1.5원"]


def amount_parse_paths(spark, sf_dir):
    v = _variant(F.col("o_orderkey"), AMOUNTS)
    own = F.concat(F.floor("o_totalprice").cast("long"), F.lit(".5"))
    c = F.when(F.col("o_orderkey") % 2 == 0, v).otherwise(own)
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.amount_strict(c).alias("strict"), amounts.amount_loose(c).alias("loose"), amounts.amount_signed(c).alias("signed"), amounts.amount_unsigned(c).alias("unsigned"), amounts.won(c).alias("won"))


amount_parse_paths.sql = f"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {_sql_variant('o_orderkey', AMOUNTS)} ELSE floor(o_totalprice)::BIGINT || '.5' END AS c FROM orders),
t AS (SELECT *, trim(c) AS t, replace(trim(c), ',', '') AS n, regexp_replace(coalesce(c, ''), '[^0-9.-]', '', 'g') AS l, regexp_replace(coalesce(c, ''), '[,\\s]', '', 'g') AS w FROM v)
SELECT o_orderkey, CASE WHEN regexp_full_match(t, '([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)\\s*원?') THEN TRY_CAST(regexp_replace(t, '[^0-9]', '', 'g') AS BIGINT) END AS strict,
  coalesce(CASE WHEN regexp_full_match(l, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST(l AS DOUBLE) END, 0) AS loose,
  CASE WHEN regexp_full_match(n, '-?[0-9]+(\\.[0-9]+)?') THEN floor(n::DOUBLE + 0.5)::BIGINT END AS signed,
  CASE WHEN regexp_full_match(coalesce(n, ''), '[0-9]+(\\.[0-9]+)?') AND floor(n::DOUBLE + 0.5) <= 9007199254740991 THEN floor(n::DOUBLE + 0.5)::BIGINT END AS unsigned,
  CASE WHEN regexp_full_match(w, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN floor(w::DOUBLE + 0.5)::BIGINT END AS won FROM t"""

DATES = ["20260115", "2026-01-15", "2026/01/15", "2026-02-31", "20261301", "2026.01.15", " 20260115 ", "", None, "2026115"]


def date_parse_paths(spark, sf_dir):
    own = F.date_format("o_orderdate", "yyyy/MM/dd")
    c = F.when(F.col("o_orderkey") % 2 == 0, _variant(F.col("o_orderkey"), DATES)).otherwise(own)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.strict_date(c).alias("strict"), dates.lenient_date(c).alias("lenient"), dates.delivery_date(c).alias("delivery"))


date_parse_paths.sql = f"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {_sql_variant('o_orderkey', DATES)} ELSE strftime(o_orderdate, '%Y/%m/%d') END AS c FROM orders),
t AS (SELECT *, trim(c) AS t, regexp_replace(coalesce(trim(c), ''), '[^0-9]', '', 'g') AS d FROM v),
u AS (SELECT *, CASE WHEN length(d) = 8 THEN substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) END AS x FROM t)
SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[0-9]{{8}}|[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}') THEN TRY_CAST(x AS DATE) END AS strict, x AS lenient, TRY_CAST(x AS DATE) AS delivery FROM u"""


def _supplier_text():
    number = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    two = F.concat(F.lit("[1^A^B^"), F.col("c_name"), F.lit("^Kim^KR^100^x^^"), number, F.lit("][2^A^B^ ^Lee^KR^0^y^^123]"))
    return F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("1^A^B^"), F.col("c_name"), F.lit("^Kim^"), number)).when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(two)


def corp_list_parse(spark, sf_dir):
    s = F.get(text.supplier_list(_supplier_text()), F.lit(0))
    out = table(spark, sf_dir, "customer").select("c_custkey", F.size(text.supplier_list(_supplier_text())).cast("long").alias("n"), s.alias("s"))
    return out.select("c_custkey", "n", "s.name", "s.representative", "s.biz_no", text.display_number(F.col("s.biz_no")).alias("shown"))


corp_list_parse.sql = """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 = 0 THEN NULL ELSE lpad(c_custkey::VARCHAR, 10, '0') END AS b, c_name FROM customer)
SELECT c_custkey, CASE WHEN b IS NULL THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN b IS NOT NULL THEN c_name END AS name, CASE WHEN b IS NOT NULL THEN 'Kim' END AS representative, b AS biz_no,
  coalesce(substr(b, 1, 3) || '-' || substr(b, 4, 2) || '-' || substr(b, 6), '') AS shown FROM t"""


def envelope_explode(spark, sf_dir):
    """Pages made of the events' payloads in the four shapes that a provider sends."""
    e = table(spark, sf_dir, "events")
    k, p = F.col("event_id") % 5, F.col("props")
    items = F.when(k == 0, F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))).when(k == 1, F.concat(F.lit('{"item":['), p, F.lit("]}"))).when(k == 2, F.concat(F.lit('{"item":'), p, F.lit("}"))).otherwise(F.lit("null"))
    code = F.when(k == 4, "99").otherwise("00")
    page = F.concat(F.lit('{"response":{"header":{"resultCode":"'), code, F.lit('"},"body":{"items":'), items, F.lit(',"totalCount":2}}}'))
    rows = envelope.exploded(e.select("event_id", page.alias("page")))
    return rows.select("event_id", F.col("item_no").cast("long").alias("item_no"), F.col("row")["k"].alias("k"))


envelope_explode.sql = """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 5 AS m FROM events)
SELECT event_id, 0::BIGINT AS item_no, k FROM e WHERE m < 3 UNION ALL SELECT event_id, 1, k FROM e WHERE m = 0"""

NAMES = ["빌딩 자동제어 설치", "BEMS 구축", "정수장 자동제어", "청사 냉난방 자동제어", "도로 공사", "ＢＥＭＳ 고도화", "학교  자동 제어", "하수 계장제어 bems"]
_SIGNALS = [(True, 1, 0), (True, 1, 0), (False, 0, 1), (True, 1, 0), (False, 0, 0), (True, 1, 0), (True, 1, 0), (False, 1, 2)]


def keyword_classify(spark, sf_dir):
    s = text.control_signals(_variant(F.col("p_partkey"), NAMES))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.related", F.size("s.positive").cast("long").alias("positive"), F.size("s.conflicting").cast("long").alias("conflicting"))


keyword_classify.sql = "SELECT p_partkey, " + ", ".join(f"([{', '.join(str(x[i]).lower() for x in _SIGNALS)}])[(p_partkey % {len(NAMES)} + 1)::INT]{cast} AS {name}" for i, name, cast in ((0, "related", ""), (1, "positive", "::BIGINT"), (2, "conflicting", "::BIGINT"))) + " FROM part"


def redact_secrets(spark, sf_dir):
    """Documents with quoted secrets and key parameters hidden."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redacted(text.without_secrets(F.col("text")))).alias("text_md5"))


redact_secrets.sql = r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(token|secret|password|key)(\s*[=:]\s*)"[^"]*"', '\1\2"[REDACTED]"', 'g'), '(?i)(serviceKey=)[^&\s]+', '\1[REDACTED]', 'g')) AS text_md5 FROM documents"""


def url_query_extract(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.query_value(u, "page").alias("page"), text.query_value(u, "ref", "000").alias("ref"), text.safe_url(u).isNotNull().alias("safe"))


url_query_extract.sql = r"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), '000') AS ref, regexp_matches(url, '^https?://') AS safe FROM pages"""


def source_row_hash(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    row = F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("c_custkey"), F.col("c_custkey").cast("string"), F.lit("address"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return c.select("c_custkey", identity.row_hash(row).alias("row_hash"))


source_row_hash.sql = """SELECT c_custkey, sha256('[["address","' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END || '"],["c_custkey","' || c_custkey || '"],["c_name","' || c_name || '"]]') AS row_hash FROM customer"""


def contract_key_fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    no, notice, url = F.when(k % 2 == 0, k.cast("string")), F.when(k % 3 == 0, F.col("o_custkey").cast("string")), F.when(k % 5 != 0, F.lit("u"))
    key = identity.contract_key(no, notice, url, F.col("o_orderpriority"))
    return o.select("o_orderkey", key.alias("c")).select("o_orderkey", "c.kind", "c.key")


contract_key_fallback.sql = """WITH v AS (SELECT o_orderkey, o_orderpriority AS p, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR END AS no, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR END AS nt, CASE WHEN o_orderkey % 5 <> 0 THEN 'u' END AS u FROM orders)
SELECT o_orderkey, CASE WHEN no IS NOT NULL THEN 'contract-no' WHEN nt IS NOT NULL AND u IS NOT NULL THEN 'notice-detail' ELSE 'fallback' END AS kind,
  sha256(CASE WHEN no IS NOT NULL THEN '["contract-no","' || no || '"]' WHEN nt IS NOT NULL AND u IS NOT NULL THEN '["notice-detail","' || nt || '","u"]' ELSE '["fallback","' || coalesce(nt, '') || '","' || p || '"]' END) AS key FROM v"""


def delivery_identities(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    change = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string"))
    return li.select("l_orderkey", "l_linenumber", identity.delivery_id(F.col("l_suppkey"), F.col("l_orderkey"), change).alias("id"), identity.delivery_number(F.col("l_orderkey").cast("string"), change, F.col("l_partkey").cast("string")).alias("number"))


delivery_identities.sql = """SELECT l_orderkey, l_linenumber, sha256(l_suppkey || ':' || l_orderkey || ':' || CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::VARCHAR ELSE '' END) AS id,
  l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '-' || l_linenumber ELSE '' END || '-' || l_partkey AS number FROM lineitem"""


def item_code_sets(spark, sf_dir):
    k = F.col("p_partkey")
    codes = F.array(F.concat(F.lit("39-12180"), F.lpad((k % 1000).cast("string"), 3, "0")), F.lit("39121801"), F.lpad(k.cast("string"), 10, "0"), F.lpad(k.cast("string"), 10, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(identity.item_codes(codes), ",").alias("codes"))


item_code_sets.sql = "SELECT p_partkey, '3912180' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || ',' || lpad(p_partkey::VARCHAR, 10, '0') AS codes FROM part"


def csv_export_projection(spark, sf_dir):
    """Export lines of the orders as contracts, with quotes and commas in their names."""
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    number = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    rows = o.select(
        "o_orderkey", number.alias("biz_no_normalized"), F.when(F.col("o_orderkey") % 2 == 0, text.display_number(number)).alias("biz_no_display"), F.concat(F.lit("A, "), "o_orderstatus").alias("business_name"),
        F.to_date("o_orderdate").cast("string").alias("contract_date"), F.concat(F.lit('a "q" '), "o_orderkey").alias("contract_name"), none.alias("notice_name"), F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("long")).alias("total_contract_amount"),
        F.col("o_orderkey").alias("current_contract_amount"), F.col("o_orderpriority").alias("demand_agency_name"), none.alias("contract_agency_name"), none.alias("contract_method"), F.lit("goods").alias("business_category"), none.alias("notice_no"),
        F.col("o_orderkey").cast("string").alias("contract_no"), none.alias("contract_detail_url"), none.alias("notice_detail_url"), F.lit("local_only").alias("source_status"),
    )
    return export.contract_lines(rows).select("o_orderkey", "line")


csv_export_projection.sql = """WITH v AS (SELECT *, lpad(o_custkey::VARCHAR, 10, '0') AS b FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN substr(b, 1, 3) || '-' || substr(b, 4, 2) || '-' || substr(b, 6) ELSE b END || ',"A, ' || o_orderstatus || '",' || strftime(o_orderdate, '%Y-%m-%d') || ',"a ""q"" ' || o_orderkey || '",,' ||
  CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice)::BIGINT ELSE o_orderkey END || ',' || o_orderpriority || ',,,goods,,' || o_orderkey || ',,,local_only' AS line FROM v"""


def nfkc_canonical_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.canonical_text(F.col("text"))).alias("canonical"), F.length(text.compact_text(F.col("text"))).cast("long").alias("compact_chars"))


def business_number_lists(spark, sf_dir):
    c = F.concat_ws(" , ", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("12-3"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lpad(F.col("o_custkey").cast("string"), 10, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.number_list(c), "|").alias("numbers"))


business_number_lists.sql = "SELECT o_orderkey, lpad(o_custkey::VARCHAR, 10, '0') || CASE WHEN o_custkey <> o_orderkey THEN '|' || lpad(o_orderkey::VARCHAR, 10, '0') ELSE '' END AS numbers FROM orders"


def designation_ends(spark, sf_dir):
    from ..sources.registry import registry

    return registry(spark).select("biz_no", "display_order", "designation_start", "designation_end")


designation_ends.sql = "SELECT biz_no, display_order, s AS designation_start, (s + INTERVAL 6 YEAR - INTERVAL 1 DAY)::DATE AS designation_end FROM (VALUES " + ", ".join(f"('{b}', {k}::INT, DATE '{d}')" for k, (_, b, _, d) in enumerate(SUPPLIERS, 1)) + ") AS v(biz_no, display_order, s)"

QUERIES = [
    category_normalise, amount_parse_paths, date_parse_paths, corp_list_parse, envelope_explode, keyword_classify, redact_secrets, url_query_extract, source_row_hash, contract_key_fallback, delivery_identities,
    item_code_sets, csv_export_projection, nfkc_canonical_text, business_number_lists, designation_ends,
]
