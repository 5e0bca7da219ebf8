"""Search, logs, coverage, windows and merges over the supplied tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import coverage, merge, search, sync
from ..sources.tables import table

NUMBERS = [7, 3, 19, 3, 11]
FROM, TO = date(1996, 1, 1), date(1996, 12, 31)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))


def contract_search(spark, sf_dir):
    """Rows of the requested suppliers in a year and category, with the supplier's name."""
    rows = search.filtered(_lines(spark, sf_dir), "l_suppkey", NUMBERS, "day", FROM, TO, "R", "l_returnflag")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return rows.join(names, "l_suppkey", "left").select("l_suppkey", "s_name", "l_orderkey", "l_partkey", "day", F.col("l_quantity").cast("long").alias("quantity"))


_FOUND = "l_suppkey IN (7, 3, 19, 11) AND l_shipdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"
contract_search.sql = f"SELECT l_suppkey, s_name, l_orderkey, l_partkey, l_shipdate::DATE AS day, l_quantity::BIGINT AS quantity FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE {_FOUND} AND l_returnflag = 'R'"


def search_summary(spark, sf_dir):
    rows = search.filtered(_lines(spark, sf_dir), "l_suppkey", NUMBERS, "day", FROM, TO)
    amount = F.floor(F.col("l_extendedprice") + 0.5).cast("long")
    return search.summary(rows, F.when(F.col("l_linestatus") == "F", amount), F.when(F.col("l_returnflag") != "N", amount), F.col("l_returnflag") == "A", "day")


search_summary.sql = f"""WITH r AS (SELECT *, floor(l_extendedprice + 0.5)::BIGINT AS x FROM lineitem WHERE {_FOUND})
SELECT count(*) AS contract_count, coalesce(sum(coalesce(CASE WHEN l_linestatus = 'F' THEN x END, CASE WHEN l_returnflag <> 'N' THEN x END, 0)), 0)::BIGINT AS total_amount,
  count(*) FILTER (l_returnflag = 'A') AS notice_linked_count, max(l_shipdate::DATE) AS latest_contract_date FROM r"""


def search_with_latest_log(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select(F.col("user_id").alias("s_suppkey"), "ts", "event_id", "event_type")
    return search.with_latest_log(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), logs, "s_suppkey", "ts", "event_id", ["event_type", "event_id"])


search_with_latest_log.sql = """WITH l AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT s_suppkey, s_name, event_type, event_id FROM supplier LEFT JOIN l ON user_id = s_suppkey AND rn = 1"""


def multi_business_search_ordered(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_suppkey", "l_orderkey", "day", F.floor("l_extendedprice").cast("long").alias("amount")).distinct()
    wanted = search.requested(spark, list(dict.fromkeys(NUMBERS)), "l_suppkey")
    keyed = rows.withColumn("tie", F.struct("l_orderkey", "amount"))
    return search.in_request_order(keyed, wanted, "l_suppkey", "day", "tie").select(F.col("place").cast("long").alias("place"), F.col("position").cast("long").alias("position"), "l_suppkey", "l_orderkey", "day", "amount")


multi_business_search_ordered.sql = """WITH q(place, l_suppkey) AS (VALUES (0, 7), (1, 3), (2, 19), (3, 11)),
r AS (SELECT DISTINCT l_suppkey, l_orderkey, l_shipdate::DATE AS day, floor(l_extendedprice)::BIGINT AS amount FROM lineitem)
SELECT place::BIGINT AS place, row_number() OVER (PARTITION BY place ORDER BY day DESC, l_orderkey DESC, amount DESC) AS position, l_suppkey, l_orderkey, day, amount FROM r JOIN q USING (l_suppkey)"""


def health(spark, sf_dir):
    return search.health(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day")


health.sql = "SELECT (SELECT count(*) FROM lineitem) AS row_count, (SELECT max(ts::DATE) FROM events) AS last_finished"


def _user_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()


def missing_ranges(spark, sf_dir):
    """Days that are there for anyone but not for a user, as runs."""
    have = _user_days(spark, sf_dir)
    span = have.agg(F.min("day").alias("a"), F.max("day").alias("b")).join(have.select("user_id").distinct(), F.lit(True))
    wanted = span.select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    return coverage.missing_days(wanted, have, ["user_id"], "day")


missing_ranges.sql = """WITH h AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), s AS (SELECT min(day) AS a, max(day) AS b FROM h),
w AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM h), s),
m AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS g FROM w ANTI JOIN h USING (user_id, day))
SELECT user_id, min(day) AS date_from, max(day) AS date_to FROM m GROUP BY user_id, g"""


def coverage_gaps(spark, sf_dir):
    """The same from intervals instead of days."""
    have = _user_days(spark, sf_dir)
    runs = coverage.islands(have, ["user_id"], "day")
    span = have.agg(F.min("day").alias("date_from"), F.max("day").alias("date_to")).join(have.select("user_id").distinct(), F.lit(True))
    return coverage.gaps(runs, span, ["user_id"])


coverage_gaps.sql = missing_ranges.sql


def covered_runs(spark, sf_dir):
    return coverage.islands(_user_days(spark, sf_dir), ["user_id"], "day")


covered_runs.sql = """WITH h AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS g FROM h)
SELECT user_id, min(day) AS date_from, max(day) AS date_to FROM g GROUP BY user_id, g"""


def coverage_merge(spark, sf_dir):
    """Coverage of each user from their event types: each type is a source."""
    e = table(spark, sf_dir, "events")
    by_type = e.groupBy("user_id", "event_type").agg(F.max("value").alias("v"), F.max("ts").alias("t"), F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    fresh = coverage.fresh(F.col("t"), F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    missing = F.array(F.struct(F.col("a").alias("date_from"), F.col("b").alias("date_to")))
    merged = coverage.merged(by_type.select("user_id", (F.col("v") > 50).alias("complete"), fresh.alias("fresh"), missing.alias("missing")), ["user_id"])
    return merged.select("user_id", "complete", "fresh", F.size("missing").cast("long").alias("ranges"), F.get("missing", F.lit(0))["date_from"].alias("first_missing"))


coverage_merge.sql = """WITH t AS (SELECT user_id, event_type, max(value) AS v, max(ts) AS t, min(ts::DATE) AS a, max(ts::DATE) AS b FROM events GROUP BY ALL)
SELECT user_id, bool_and(v > 50) AS complete, bool_and(t > TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 24 HOUR) AS fresh, count(DISTINCT (a, b)) AS ranges, min(a) AS first_missing FROM t GROUP BY user_id"""


def _ranges(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.min(F.to_date("o_orderdate")).alias("date_from"), F.max(F.to_date("o_orderdate")).alias("date_to"))


_RANGES = "r AS (SELECT o_custkey AS custkey, min(o_orderdate::DATE) AS date_from, max(o_orderdate::DATE) AS date_to FROM orders GROUP BY o_custkey)"
_WINDOWS = ["custkey", "window_from", "window_to"]


def month_chunks(spark, sf_dir):
    return dates.month_windows(_ranges(spark, sf_dir)).select(*_WINDOWS)


month_chunks.sql = f"""WITH {_RANGES}, m AS (SELECT *, unnest(generate_series(date_trunc('month', date_from), date_to, INTERVAL 1 MONTH))::DATE AS a FROM r)
SELECT custkey, greatest(a, date_from) AS window_from, least(last_day(a), date_to) AS window_to FROM m"""


def week_chunks(spark, sf_dir):
    return dates.week_windows(_ranges(spark, sf_dir)).select(*_WINDOWS)


week_chunks.sql = f"""WITH {_RANGES}, m AS (SELECT *, unnest(generate_series(date_from, date_to, INTERVAL 7 DAY))::DATE AS a FROM r)
SELECT custkey, a AS window_from, least(a + 6, date_to) AS window_to FROM m"""


def _user_ranges(spark, sf_dir):
    return _user_days(spark, sf_dir).groupBy("user_id").agg(F.min("day").alias("date_from"), F.max("day").alias("date_to"))


_USERS = "r AS (SELECT user_id, min(ts::DATE) AS date_from, max(ts::DATE) AS date_to FROM events GROUP BY user_id)"


def day_chunks(spark, sf_dir):
    return dates.day_windows(_user_ranges(spark, sf_dir)).select("user_id", "window_from", "window_to")


day_chunks.sql = f"WITH {_USERS}, m AS (SELECT user_id, unnest(generate_series(date_from, date_to, INTERVAL 1 DAY))::DATE AS a FROM r) SELECT user_id, a AS window_from, a AS window_to FROM m"


def hybrid_windows(spark, sf_dir):
    return dates.hybrid_windows(_user_ranges(spark, sf_dir), date(2024, 1, 25)).select("user_id", "window_from", "window_to")


hybrid_windows.sql = f"""WITH {_USERS}, e AS (SELECT *, DATE '2024-01-12' AS edge FROM r),
w AS (SELECT user_id, least(date_to, edge - 1) AS b, unnest(generate_series(date_from, least(date_to, edge - 1), INTERVAL 7 DAY))::DATE AS a FROM e WHERE date_from < edge),
d AS (SELECT user_id, unnest(generate_series(greatest(date_from, edge), date_to, INTERVAL 1 DAY))::DATE AS a FROM e WHERE date_to >= edge)
SELECT user_id, a AS window_from, least(a + 6, b) AS window_to FROM w UNION ALL SELECT user_id, a, a FROM d"""


def recent_window(spark, sf_dir):
    return _ranges(spark, sf_dir).select("custkey", dates.recent_window(F.col("date_from"), F.col("date_to")).alias("recent_from"), dates.months_between_inclusive(F.col("date_from"), F.col("date_to")).cast("long").alias("months"))


recent_window.sql = f"WITH {_RANGES} SELECT custkey, greatest(date_to - 13, date_from) AS recent_from, greatest(year(date_to) * 12 + month(date_to) - year(date_from) * 12 - month(date_from) + 1, 1)::BIGINT AS months FROM r"


def interval_overlap_join(spark, sf_dir):
    """Runs of covered days against the weeks of the user's whole range."""
    runs = coverage.islands(_user_days(spark, sf_dir), ["user_id"], "day")
    weeks = dates.week_windows(_user_ranges(spark, sf_dir)).select("user_id", F.col("window_from").alias("r_from"), F.col("window_to").alias("r_to"))
    return coverage.overlapping(runs, weeks, ["user_id"]).select("user_id", "date_from", "date_to", "r_from", "r_to")


interval_overlap_join.sql = f"""WITH {_USERS}, runs AS ({covered_runs.sql}), w AS (SELECT user_id, date_to AS z, unnest(generate_series(date_from, date_to, INTERVAL 7 DAY))::DATE AS a FROM r)
SELECT runs.user_id, date_from, date_to, a AS r_from, least(a + 6, z) AS r_to FROM runs JOIN w ON w.user_id = runs.user_id AND date_from <= least(a + 6, z) AND date_to >= a"""


def cached_prefix_choice(spark, sf_dir):
    """Of a customer's order days as cached ends, the shortest that covers mid 1998, else the longest."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("date_to"))
    return coverage.best_prefix(e, F.lit("1998-07-01").cast("date"), ["custkey"])


cached_prefix_choice.sql = "SELECT o_custkey AS custkey, coalesce(min(o_orderdate::DATE) FILTER (o_orderdate::DATE >= DATE '1998-07-01'), max(o_orderdate::DATE)) AS date_to FROM orders GROUP BY o_custkey"


def delivery_plan(spark, sf_dir):
    """Months of each user's range against a cache that holds what their purchases reach."""
    months = dates.month_windows(_user_ranges(spark, sf_dir)).select("user_id", "window_from", "window_to")
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("date_to"), F.max("ts").alias("cached_at"))
    entries = e.join(_user_ranges(spark, sf_dir).select("user_id", F.col("date_from").alias("window_from")), "user_id")
    out = coverage.delivery_plan(months, entries, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), ["user_id"])
    return out.select("user_id", "window_from", "window_to", "plan", "fetch_from", "fetch_to")


delivery_plan.sql = f"""WITH {_USERS}, m AS (SELECT user_id, date_from, date_to, unnest(generate_series(date_trunc('month', date_from), date_to, INTERVAL 1 MONTH))::DATE AS a FROM r),
w AS (SELECT user_id, greatest(a, date_from) AS window_from, least(last_day(a), date_to) AS window_to FROM m),
e AS (SELECT user_id, max(ts::DATE) AS p, max(ts) AS c FROM events WHERE event_type = 'purchase' GROUP BY user_id),
x AS (SELECT w.*, CASE WHEN e.c > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR THEN e.p END AS p FROM w JOIN r USING (user_id) LEFT JOIN e ON e.user_id = w.user_id AND w.window_from = r.date_from),
y AS (SELECT *, greatest(coalesce(p + 1, window_from), window_from) AS s FROM x)
SELECT user_id, window_from, window_to, CASE WHEN s > window_to THEN 'complete' WHEN p IS NOT NULL THEN 'suffix' ELSE 'full' END AS plan,
  CASE WHEN s <= window_to THEN s END AS fetch_from, CASE WHEN s <= window_to THEN window_to END AS fetch_to FROM y"""


def header_detail_semijoin(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.to_date("o_orderdate") >= "2000-01-01")).select(F.col("o_orderkey").alias("l_orderkey"))
    return sync.details(heads, table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_suppkey").agg(F.count("*").alias("lines"))


header_detail_semijoin.sql = "SELECT l_suppkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY l_suppkey"


def header_matches(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").cast("string").alias("request"), F.col("o_orderpriority").alias("method"))
    return sync.header_matches(h, "custkey", "request", "method", "URGENT").select("custkey", F.size("requests").cast("long").alias("requests"), "matched")


header_matches.sql = "SELECT o_custkey AS custkey, count(DISTINCT o_orderkey) AS requests, count(*) AS matched FROM orders WHERE o_orderpriority LIKE '%URGENT%' GROUP BY o_custkey"


def item_code_enrichment(spark, sf_dir):
    """Parts without a size code get the types that their brand's parts have."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.array(F.concat(F.lit("S"), F.col("p_size")))).alias("codes"))
    out = sync.enrich_codes(rows, p.select("p_brand", "p_type"), "p_brand", "codes", "p_type")
    return out.select("p_partkey", F.array_join("codes", ",").alias("codes"))


item_code_enrichment.sql = """WITH c AS (SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS c FROM part GROUP BY p_brand)
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'S' || p_size ELSE c END AS codes FROM part JOIN c USING (p_brand)"""


def sync_status_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = {"fetched": F.lit(1), "matched": F.when(F.col("value") > 20, 1).otherwise(0), "inserted": F.when(F.col("event_type") == "purchase", 1).otherwise(0), "updated": F.when(F.col("event_type") == "signup", 1).otherwise(0), "errors": F.when(F.col("value") > 400, 1).otherwise(0)}
    return sync.rollup(e.select("user_id", *(c.alias(k) for k, c in kinds.items())), ["user_id"], list(kinds))


sync_status_rollup.sql = """WITH c AS (SELECT user_id, count(*)::BIGINT AS fetched, count(*) FILTER (value > 20)::BIGINT AS matched, count(*) FILTER (event_type = 'purchase')::BIGINT AS inserted,
  count(*) FILTER (event_type = 'signup')::BIGINT AS updated, count(*) FILTER (value > 400)::BIGINT AS errors FROM events GROUP BY user_id)
SELECT *, CASE WHEN errors = 0 THEN 'success' WHEN inserted + updated = 0 THEN 'failed' ELSE 'partial' END AS status FROM c"""


def _merge_sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("v"), F.to_date("o_orderdate").alias("d"))
    old = o.where(F.col("d") < "1997-01-01").groupBy("k").agg(F.max_by("v", "n").alias("v")).withColumn("source_status", F.lit("api_enriched"))
    return old, o.where(F.col("d") >= "1997-01-01").select("k", "v", "n")


_SIDES = """o AS (SELECT o_custkey AS k, o_orderkey AS n, o_orderpriority AS v, o_orderdate::DATE AS d FROM orders),
old AS (SELECT k, arg_max(v, n) AS v FROM o WHERE d < DATE '1997-01-01' GROUP BY k), src AS (SELECT * FROM o WHERE d >= DATE '1997-01-01')"""


def snapshot_upsert(spark, sf_dir):
    old, new = _merge_sides(spark, sf_dir)
    return merge.upsert(old, new, ["k"], "n", ["source_status"], {"source_status": F.lit("local_only")})


snapshot_upsert.sql = f"""WITH {_SIDES}, s AS (SELECT k, arg_max(v, n) AS v FROM src GROUP BY k)
SELECT coalesce(old.k, s.k) AS k, coalesce(s.v, old.v) AS v, CASE WHEN old.k IS NOT NULL THEN 'api_enriched' ELSE 'local_only' END AS source_status FROM old FULL JOIN s ON old.k = s.k"""


def upsert_counts(spark, sf_dir):
    old, new = _merge_sides(spark, sf_dir)
    return merge.upsert_counts(old, new, ["k"])


upsert_counts.sql = f"""WITH {_SIDES}, c AS (SELECT k, count(*) AS n, k NOT IN (SELECT k FROM old) AS new FROM src GROUP BY k)
SELECT count(*) FILTER (new) AS inserted, (sum(n) - count(*) FILTER (new))::BIGINT AS updated FROM c"""


def _profiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    some = lambda m, r, v: F.when(k % m != r, v)
    old = c.select(k.alias("biz"), some(3, 0, F.col("c_name")).alias("name"), some(4, 1, F.col("c_mktsegment")).alias("address"), F.element_at(F.array(*map(F.lit, ("csv", "excellent-products-csv", "user-info", "other"))), (k % 4 + 1).cast("int")).alias("profile_source"))
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    new = o.select(F.col("o_custkey").alias("biz"), F.when(n % 3 == 0, F.col("o_orderpriority")).alias("name"), F.when(n % 5 == 0, F.col("o_orderstatus")).alias("address"), F.lit("excellent-products-csv").alias("profile_source"), n.alias("n"))
    return old, new


def profile_priority_merge(spark, sf_dir):
    old, new = _profiles(spark, sf_dir)
    return merge.merge_profiles(old, new, "biz", ["name", "address"], "n")


profile_priority_merge.sql = """WITH e AS (SELECT c_custkey AS biz, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 <> 1 THEN c_mktsegment END AS address,
  CASE c_custkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'excellent-products-csv' WHEN 2 THEN 'user-info' ELSE 'other' END AS profile_source FROM customer),
i AS (SELECT o_custkey AS biz, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS name, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS address, o_orderkey AS n FROM orders),
b AS (SELECT biz, arg_max(name, n) FILTER (name IS NOT NULL) AS ln, arg_min(name, n) FILTER (name IS NOT NULL) AS fn, arg_max(address, n) FILTER (address IS NOT NULL) AS la, arg_min(address, n) FILTER (address IS NOT NULL) AS fa FROM i GROUP BY biz)
SELECT coalesce(e.biz, b.biz) AS biz, CASE WHEN e.profile_source = 'user-info' THEN coalesce(e.name, b.fn) ELSE coalesce(b.ln, e.name) END AS name,
  CASE WHEN e.profile_source = 'user-info' THEN coalesce(e.address, b.fa) ELSE coalesce(b.la, e.address) END AS address,
  CASE WHEN e.profile_source = 'user-info' THEN e.profile_source ELSE CASE WHEN b.biz IS NOT NULL THEN 'excellent-products-csv' ELSE e.profile_source END END AS profile_source FROM e FULL JOIN b ON e.biz = b.biz"""


def enrichment_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    records = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("method"), F.lit("local_only").alias("source_status"))
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("method"))
    return merge.enrich(records, found, "id", ["method"])


enrichment_update.sql = """WITH f AS (SELECT o_custkey AS id, max(o_orderpriority) AS m FROM orders GROUP BY o_custkey), r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS method FROM customer)
SELECT r.id, coalesce(m, method) AS method, CASE WHEN m IS NOT NULL AND m IS DISTINCT FROM method THEN 'api_enriched' ELSE 'local_only' END AS source_status FROM r LEFT JOIN f USING (id)"""

QUERIES = [
    contract_search, search_summary, search_with_latest_log, multi_business_search_ordered, health, missing_ranges, coverage_gaps, covered_runs, coverage_merge, month_chunks, week_chunks, day_chunks, hybrid_windows,
    recent_window, interval_overlap_join, cached_prefix_choice, delivery_plan, header_detail_semijoin, header_matches, item_code_enrichment, sync_status_rollup, snapshot_upsert, upsert_counts, profile_priority_merge, enrichment_update,
]
