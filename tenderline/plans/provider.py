"""Provider rows, identities and cache rules over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, identity, text
from ..operators import coverage, mappers, merge, overview, sync, versions
from ..sources import csv_index
from ..sources.tables import registry_keys, table
from .records import _USERS, _user_ranges
from .scalars import _sql_variant, _variant


def _number(c):
    return F.lpad(c.cast("string"), 10, "0")


def _map(**fields):
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string") if not isinstance(v, str) else F.lit(v))))


def group_versions(spark, sf_dir):
    """The key under which versions of a contract meet."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = identity.contract_key(F.when(k % 2 == 0, k.cast("string")), F.when(k % 3 == 0, F.col("o_custkey").cast("string")), F.when(k % 5 != 0, F.lit("u")), F.col("o_orderpriority"))
    original = F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", identity.group_key(key["kind"], key["key"], original, F.col("o_orderstatus")).alias("grp"))


group_versions.sql = """WITH v AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS og, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR END AS no,
  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR END AS nt, CASE WHEN o_orderkey % 5 <> 0 THEN 'u' END AS u FROM orders)
SELECT o_orderkey, sha256(CASE WHEN no IS NOT NULL THEN '["contract-no","' || no || '"]' WHEN nt IS NOT NULL AND u IS NOT NULL THEN '["notice-detail","' || nt || '","u"]' WHEN og IS NOT NULL THEN '["fallback-original","' || og || '","' || s || '"]'
  ELSE '["fallback","' || coalesce(nt, '') || '","' || p || '"]' END) AS grp FROM v"""


def summary_identities(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    no, notice, url = F.when(k % 4 == 0, F.concat(F.lit(" R"), k)), F.when(k % 3 == 0, F.concat(F.lit("N"), F.col("o_custkey"))), F.when(k % 5 != 0, F.lit("HTTP://X/"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", identity.summary_identity(no, notice, url, F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit(None).cast("string"), day).alias("contract"), identity.notice_identity(notice, url).alias("notice"))


summary_identities.sql = """WITH v AS (SELECT o_orderkey AS k, lower(o_orderpriority) AS p, lower(o_orderstatus) AS s, strftime(o_orderdate, '%Y-%m-%d') AS d, CASE WHEN o_orderkey % 4 = 0 THEN 'r' || o_orderkey END AS no,
  CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_custkey END AS nt, CASE WHEN o_orderkey % 5 <> 0 THEN 'http://x/' END AS u FROM orders)
SELECT k AS o_orderkey, CASE WHEN no IS NOT NULL THEN 'contract:' || no WHEN nt IS NOT NULL AND u IS NOT NULL THEN 'notice-detail:' || nt || ':' || u ELSE 'fallback:' || sha256('["' || p || '","' || s || '","","' || d || '","' || coalesce(u, '') || '"]') END AS contract,
  CASE WHEN nt IS NOT NULL THEN 'notice:' || nt WHEN u IS NOT NULL THEN 'notice-url:' || u END AS notice FROM v"""


def delivery_detail_rows(spark, sf_dir):
    """Unit-price delivery lines of the registry as canonical rows."""
    c, n = F.col, F.col("l_linenumber")
    row = _map(
        cntrctCorpBizno=_number(c("l_suppkey")), cntrctCnclsStleNm=F.when(n % 2 == 0, "제3자단가계약").otherwise("총액계약"), corpNm=F.concat(F.lit("S"), "l_suppkey"), dlvrReqNo=c("l_orderkey"), dlvrReqChgOrd=n, prdctSno=c("l_partkey"),
        prdctAmt=F.when(n % 4 == 0, "0").otherwise(F.floor("l_extendedprice").cast("long").cast("string")), incdecAmt="-5", dlvrReqRcptDate=F.date_format("l_shipdate", "yyyyMMdd"), prdctIdntNoNm=F.when(c("l_partkey") % 3 != 0, c("l_partkey").cast("string")),
        dlvrReqNm=F.concat(F.lit("D"), "l_orderkey"),
    )
    numbers = registry_keys(spark, sf_dir).select(_number(c("supplier")).alias("biz_no"))
    out = mappers.delivery_details(table(spark, sf_dir, "lineitem").select(row.alias("row")), numbers)
    return out.select("biz_no_normalized", "unified_contract_no", "contract_name", "contract_date", "total_contract_amount")


delivery_detail_rows.sql = """SELECT lpad(l_suppkey::VARCHAR, 10, '0') AS biz_no_normalized, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS unified_contract_no, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey::VARCHAR ELSE 'D' || l_orderkey END AS contract_name,
  l_shipdate::DATE AS contract_date, CASE WHEN l_linenumber % 4 = 0 THEN -5 ELSE floor(l_extendedprice)::BIGINT END AS total_contract_amount FROM lineitem WHERE l_suppkey < 22 AND l_linenumber % 2 = 0"""


def product_delivery_rows(spark, sf_dir):
    """Final deliveries of one product by the registry as competitor rows."""
    c, n = F.col, F.col("l_linenumber")
    row = _map(
        bizno=_number(c("l_suppkey")), dtilPrdctClsfcNo=F.when(c("l_partkey") % 2 == 0, "3912180101").otherwise("3912180102"), cntrctDivNm="제3자단가계약", cntrctDlvrDivNm=F.when(c("l_partkey") % 3 != 0, "납품요구").otherwise("총액"),
        fnlCntrctDlvrReqChgOrdYn=F.when(n % 2 == 1, "y").otherwise("N"), cntrctDlvrReqDate=F.date_format("l_shipdate", "yyyyMMdd"), cntrctDlvrReqNo=c("l_orderkey"), cntrctDlvrReqChgOrd=n, prdctIdntNo=c("l_partkey"),
        prdctAmt=F.floor("l_extendedprice").cast("long"), corpNm=F.when(c("l_suppkey") % 2 == 0, F.concat(F.lit("S"), "l_suppkey")),
    )
    lines = table(spark, sf_dir, "lineitem").select(row.alias("row"))
    numbers = registry_keys(spark, sf_dir).select(_number(c("supplier")).alias("biz_no"))
    out = mappers.product_deliveries(lines.unionAll(lines), numbers, "3912180101")  # the provider sends rows twice
    return out.select("id", "biz_no", "business_name", "contract_no", "contract_date", "total_contract_amount")


product_delivery_rows.sql = """SELECT DISTINCT sha256(lpad(l_suppkey::VARCHAR, 10, '0') || ':' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_shipdate::DATE || ':' || floor(l_extendedprice)::BIGINT) AS id, lpad(l_suppkey::VARCHAR, 10, '0') AS biz_no,
  CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey ELSE lpad(l_suppkey::VARCHAR, 10, '0') END AS business_name, l_orderkey::VARCHAR AS contract_no, l_shipdate::DATE AS contract_date, floor(l_extendedprice)::BIGINT AS total_contract_amount
FROM lineitem WHERE l_suppkey < 22 AND l_partkey % 2 = 0 AND l_partkey % 3 <> 0 AND l_linenumber % 2 = 1"""


def lookup_enrichment(spark, sf_dir):
    """Orders with what is known under their notice, contract and unified numbers."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    notices = c.where(k % 5 != 0).select(k.cast("string").alias("notice_no"), F.col("c_name").alias("notice_name"))
    contracts = c.where(k % 4 != 0).select(F.concat(F.lit("K"), k).alias("contract_no"), k.cast("string").alias("unified_contract_no"), F.col("c_mktsegment").alias("method"))
    bids = c.where(k % 3 == 0).select(k.cast("string").alias("notice_no"))
    key = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", key.cast("string").alias("notice_no"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("K"), key + 1)).alias("contract_no"), key.cast("string").alias("unified_contract_no"))
    return sync.enrich_lookups(rows, notices, contracts, bids).select("o_orderkey", "notice_name", F.col("contract.method").alias("method"), "bid_matched")


lookup_enrichment.sql = """SELECT o_orderkey, n.c_name AS notice_name, coalesce(a.c_mktsegment, b.c_mktsegment) AS method, o_custkey % 3 = 0 AS bid_matched FROM orders LEFT JOIN customer n ON n.c_custkey = o_custkey AND n.c_custkey % 5 <> 0
  LEFT JOIN customer a ON o_orderkey % 2 = 0 AND a.c_custkey = o_custkey + 1 AND a.c_custkey % 4 <> 0 LEFT JOIN customer b ON b.c_custkey = o_custkey AND b.c_custkey % 4 <> 0"""


def valid_cache_entries(spark, sf_dir):
    """Lines of the orders in which every line is valid."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return coverage.valid_entries(li, ["l_orderkey"], F.when(F.col("l_linenumber") < 7, F.col("l_quantity") < 45)).select("l_orderkey", "l_linenumber")


valid_cache_entries.sql = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 7 OR l_quantity >= 45)"


def preserved_prefixes(spark, sf_dir):
    """Cached ranges cut off before a recent window."""
    now, edge = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20").cast("date")
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("date_from"), F.max(F.to_date("ts")).alias("date_to"), F.max("ts").alias("cached_at"))
    return merge.preserve_prefix(e, edge, now)


preserved_prefixes.sql = """WITH e AS (SELECT user_id, event_type, min(ts::DATE) AS a, max(ts::DATE) AS b, max(ts) AS c FROM events GROUP BY ALL)
SELECT user_id, event_type, a AS date_from, least(b, DATE '2024-01-19') AS date_to, CASE WHEN b > DATE '2024-01-19' THEN TIMESTAMP '2024-02-01' ELSE c END AS cached_at FROM e WHERE a < DATE '2024-01-20'"""


def replaced_ranges(spark, sf_dir):
    """Cached days without those that meet a fetched range of their user, and the fetched ranges."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    cache = e.select("user_id", F.col("day").alias("date_from"), F.date_add("day", 2).alias("date_to"), F.lit("old").alias("v")).distinct()
    fetched = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("day").alias("date_from"), F.max("day").alias("date_to")).withColumn("v", F.lit("new"))
    return merge.replace_ranges(cache, fetched, ["user_id"])


replaced_ranges.sql = """WITH f AS (SELECT user_id, min(ts::DATE) AS a, max(ts::DATE) AS b FROM events WHERE event_type = 'purchase' GROUP BY user_id), c AS (SELECT DISTINCT user_id, ts::DATE AS a, ts::DATE + 2 AS b FROM events)
SELECT user_id, a AS date_from, b AS date_to, 'new' AS v FROM f UNION ALL SELECT user_id, a, b, 'old' FROM c WHERE NOT EXISTS (FROM f WHERE f.user_id = c.user_id AND c.a <= f.b AND c.b >= f.a)"""


def partial_presence(spark, sf_dir):
    """Whether a user's wanted range counts as there, given what is missing of it."""
    r = _user_ranges(spark, sf_dir)
    one = lambda a, b: F.struct(a.alias("date_from"), b.alias("date_to"))
    a, b, k = F.col("date_from"), F.col("date_to"), F.col("user_id") % 3
    missing = F.when(k == 0, F.array(one(a, b))).when(k == 1, F.array(one(a, F.date_sub(b, 1)))).otherwise(F.array().cast("array<struct<date_from:date,date_to:date>>"))
    return r.select("user_id", coverage.partly_there(a, b, missing).alias("there"))


partial_presence.sql = f"WITH {_USERS} SELECT user_id, user_id % 3 <> 0 AS there FROM r"


def seoul_days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(dates.seoul_day(F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n"))


seoul_days.sql = "SELECT (ts + INTERVAL 9 HOUR)::DATE AS day, count(*) AS n FROM events GROUP BY 1"


def addresses_and_codes(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    detail = F.when(k % 4 == 1, F.substring("c_name", 4, 99)).when(k % 4 == 2, F.concat("c_name", F.lit(" x"))).when(k % 4 == 3, F.lit(" z "))
    code = _variant(k, ["39121801", "39-121801 ", "3912180102", None])
    suppliers = F.array(*(F.struct(F.lit(b).alias("biz_no"), n.alias("name"), F.lit(q).alias("raw")) for b, n, q in (("1", F.col("c_name"), 1), ("1", F.col("c_name"), 2), ("2", F.col("c_name"), 3))))
    return c.select("c_custkey", mappers.combined_address(F.col("c_name"), detail).alias("address"), mappers.canonical_code(code).alias("code"), F.size(versions.distinct_suppliers(suppliers)).cast("long").alias("suppliers"), identity.registry_key(F.array(_number(k), _number(k + 1), _number(k))).alias("registry"))


addresses_and_codes.sql = """SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 2 THEN ' x' WHEN 3 THEN ' z' ELSE '' END AS address, (['3912180101', '3912180101', '3912180102', NULL])[(c_custkey % 4 + 1)::INT] AS code, 2::BIGINT AS suppliers,
  lpad(c_custkey::VARCHAR, 10, '0') || ',' || lpad((c_custkey + 1)::VARCHAR, 10, '0') AS registry FROM customer"""


def isolated_errors(spark, sf_dir):
    """Rows that may be merged, and bad ones by reason."""
    li = table(spark, sf_dir, "lineitem")
    good, bad = merge.split_valid(li.select("l_suppkey", "l_quantity", "l_returnflag"), F.when(F.col("l_quantity") > 45, "quantity").when(F.col("l_returnflag") == "R", "flag"))
    return good.groupBy().count().select(F.lit("none").alias("reason"), F.col("count").alias("n")).unionByName(bad.groupBy("reason").agg(F.count("*").alias("n")))


isolated_errors.sql = "SELECT CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_returnflag = 'R' THEN 'flag' ELSE 'none' END AS reason, count(*) AS n FROM lineitem GROUP BY 1"


def registry_without_figures(spark, sf_dir):
    return overview.unavailable(registry_keys(spark, sf_dir), "collecting")


registry_without_figures.sql = "SELECT s_suppkey AS supplier, s_suppkey AS display_order, 'collecting' AS collection_status, NULL::BIGINT AS contract_count, NULL::BIGINT AS total_amount, NULL::DATE AS latest_date FROM supplier WHERE s_suppkey < 22"


def index_lines(spark, sf_dir):
    """Fields of index lines with quotes at the start, inside and without an end."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    quoted = F.when(k % 3 == 0, F.lit('"a ""b"", c" tail')).when(k % 3 == 1, F.lit('A "x, y" z')).otherwise(F.lit('p""q'))
    line = F.concat(F.when(k % 2 == 0, F.col("c_name")).otherwise(F.lit("")), F.lit(","), quoted, F.lit(",,"), k.cast("string"), F.when(k % 5 == 0, F.lit(',"no end, at all')).otherwise(F.lit("")))
    f = csv_index.fields_of(line)
    return c.select("c_custkey", F.size(f).cast("long").alias("n"), F.array_join(f, "|").alias("fields"))


index_lines.sql = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 5 ELSE 4 END::BIGINT AS n, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END || '|' || (['a "b", c tail', 'A x, y z', 'pq'])[(c_custkey % 3 + 1)::INT] || '||' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '|no end, at all' ELSE '' END AS fields FROM customer"""


def item_counters(spark, sf_dir):
    """Fetched items, matched rows, and items that made none."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    return sync.item_counts(items, table(spark, sf_dir, "lineitem").where("l_suppkey < 22").select(F.col("l_orderkey").alias("item")), ["item"])


item_counters.sql = "WITH m AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey < 22 GROUP BY 1) SELECT count(*) AS fetched, coalesce(sum(n), 0)::BIGINT AS matched, count(*) FILTER (n IS NULL) AS skipped FROM orders LEFT JOIN m ON k = o_orderkey"

TYPED = ["2026", "20260", "2026-01-1", "2026011599", "", "20a26"]
MESSAGES = ["SERVICE KEY IS NOT REGISTERED", "Access Denied", "date range exceeded", "조회 기간 초과", "인증 실패", "time out", ""]


def typed_dates_and_messages(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.compact_date_input(_variant(k, TYPED)).alias("typed"), text.error_kind(_variant(k, MESSAGES)).alias("kind"))


typed_dates_and_messages.sql = f"""WITH v AS (SELECT p_partkey, left(regexp_replace({_sql_variant('p_partkey', TYPED)}, '[^0-9]', '', 'g'), 8) AS d, {_sql_variant('p_partkey', MESSAGES)} AS m FROM part)
SELECT p_partkey, CASE WHEN length(d) <= 4 THEN d WHEN length(d) <= 6 THEN left(d, 4) || '-' || substr(d, 5) ELSE left(d, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7) END AS typed,
  CASE WHEN regexp_matches(m, '(?i)service ?key|not registered|unauthori[sz]ed|forbidden|access denied|인증|권한') THEN 'unauthorized' WHEN regexp_matches(m, '(?i)date.*(range|exceed)|range.*date|기간|조회.*초과') THEN 'date_range_too_large' ELSE 'other' END AS kind FROM v"""


def raw_payload_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", identity.raw_text_hash(F.col("props")).alias("raw_hash"))


raw_payload_hashes.sql = "SELECT event_id, sha256(props) AS raw_hash FROM events"


def estimated_companies(spark, sf_dir):
    """Companies with a contract that was split in equal shares."""
    split = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(overview.estimated(F.when(F.col("l_linenumber") > 6, "equal-share").otherwise("full-contract")).alias("estimated"))
    return split


estimated_companies.sql = "SELECT l_suppkey, bool_or(l_linenumber > 6) AS estimated FROM lineitem GROUP BY l_suppkey"


def code_unions(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select("p_partkey", F.array_join(identity.merged_codes(F.array(F.lit("3912180101"), _number(k)), F.when(k % 2 == 0, F.array(_number(k), F.lit("x"), F.lit("39-12180199")))), ",").alias("codes"))


code_unions.sql = "SELECT p_partkey, '3912180101,' || lpad(p_partkey::VARCHAR, 10, '0') || CASE WHEN p_partkey % 2 = 0 THEN ',3912180199' ELSE '' END AS codes FROM part"

CELLS = ["2026-01-31", "2026-02-30", "2024-02-29", "2026-1-31", "20260131", "", "0000-01-01", "2026-12-31 "]


def sheet_dates(spark, sf_dir):
    """Texts as the dates of a sheet's cells."""
    return table(spark, sf_dir, "part").select("p_partkey", dates.sheet_date(_variant(F.col("p_partkey"), CELLS)).alias("day"))


sheet_dates.sql = f"""WITH v AS (SELECT p_partkey, {_sql_variant('p_partkey', CELLS)} AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND left(t, 2) <> '00' THEN try_cast(t AS DATE) END AS day FROM v"""

QUERIES = [
    group_versions, summary_identities, delivery_detail_rows, product_delivery_rows, lookup_enrichment, valid_cache_entries, preserved_prefixes, replaced_ranges, partial_presence, seoul_days, addresses_and_codes, isolated_errors,
    registry_without_figures, index_lines, item_counters, typed_dates_and_messages, raw_payload_hashes, estimated_companies, code_unions, sheet_dates,
]
