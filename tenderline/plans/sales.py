"""Versions, attribution and the sales overview over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import Period
from ..operators import attribution, export, overview, versions
from ..sources.tables import contract_rows, contracts, registry_keys, table

YEAR = 1996
ROWS = """rows AS (SELECT l_orderkey AS contract, l_suppkey AS supplier, (l_linenumber - 1)::BIGINT AS ord, year(l_shipdate)::BIGINT AS yr,
  floor(l_extendedprice + 0.5)::BIGINT AS amount, l_partkey AS part, l_shipdate::DATE AS ship FROM lineitem),
heads AS (SELECT o_orderkey AS contract, floor(o_totalprice + 0.5)::BIGINT AS ceiling, o_orderdate::DATE AS signed, o_custkey AS agency FROM orders)"""
TIE = "ord DESC, yr DESC, amount DESC, part DESC, supplier DESC, ship DESC"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_rows(spark, sf_dir).withColumns({"ord": F.col("ord").cast("long"), "yr": F.col("yr").cast("long")})


def _tie() -> list:
    return [F.col(c).desc() for c in ("amount", "part", "supplier", "ship")]


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry sales of the year's contracts."""
    heads = contracts(spark, sf_dir, YEAR)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_type")
    rows = _rows(spark, sf_dir).join(heads, "contract").withColumnsRenamed({"yr": "date", "ceiling": "total"}).join(parts, "part")
    return overview.registry_sales(rows, registry_keys(spark, sf_dir), F.col("p_type") == "PROMO", [F.col("part").desc(), F.col("ship").desc()])


SALES = ROWS + f""",
mine AS (SELECT r.*, h.ceiling, h.signed, p.p_type, count(*) OVER (PARTITION BY r.supplier, r.contract) AS source_rows FROM rows r JOIN heads h USING (contract)
  JOIN part p ON p.p_partkey = r.part WHERE r.supplier < 22 AND year(h.signed) = {YEAR}),
cand AS (SELECT *, max(ord = 0) OVER (PARTITION BY contract) AS has FROM mine),
chosen AS (SELECT *, rank() OVER (PARTITION BY contract ORDER BY ord DESC, yr DESC) AS rk FROM cand WHERE ord = 0 OR NOT has),
rep AS (SELECT *, row_number() OVER (PARTITION BY contract, supplier ORDER BY ord DESC, yr DESC, amount DESC, part DESC, ship DESC) AS rn FROM chosen WHERE rk = 1),
sales AS (SELECT * FROM rep WHERE rn = 1 AND p_type = 'PROMO')"""

COMPANIES = SALES + """,
sums AS (SELECT supplier, count(*) AS n, sum(amount)::BIGINT AS t, max(yr) AS d FROM sales GROUP BY supplier),
ranked AS (SELECT s.s_suppkey AS supplier, s.s_suppkey AS display_order, coalesce(n, 0)::BIGINT AS contract_count, coalesce(t, 0)::BIGINT AS total_amount, d AS latest_date,
  row_number() OVER (ORDER BY coalesce(t, 0) DESC, s.s_suppkey) AS rank FROM supplier s LEFT JOIN sums ON sums.supplier = s.s_suppkey WHERE s.s_suppkey < 22)"""


def company_sales_ranking(spark, sf_dir):
    ranked = overview.companies(_sales(spark, sf_dir), registry_keys(spark, sf_dir))
    return ranked.select("rank", "supplier", "display_order", "contract_count", "total_amount", "latest_date")


company_sales_ranking.sql = f"WITH {COMPANIES} SELECT rank, supplier, display_order, contract_count, total_amount, latest_date FROM ranked"


def overall_sales_totals(spark, sf_dir):
    sales = _sales(spark, sf_dir)
    return overview.overall(sales, "total")


overall_sales_totals.sql = f"""WITH {SALES}, each AS (SELECT contract, sum(amount) AS a, max(ceiling) AS c, max(yr) AS d FROM sales GROUP BY contract)
SELECT count(*) AS contract_count, coalesce(sum(least(a, c)), 0)::BIGINT AS total_amount, max(d) AS latest_date FROM each"""


def source_row_counts(spark, sf_dir):
    return _sales(spark, sf_dir).select("supplier", "contract", "amount", "source_rows")


source_row_counts.sql = f"WITH {SALES} SELECT supplier, contract, amount, source_rows FROM sales"


def company_contracts(spark, sf_dir):
    """The nested overview: each company's contracts as one array, latest and largest first, shown as text."""
    sales = _sales(spark, sf_dir)
    tree = overview.nested(overview.companies(sales, registry_keys(spark, sf_dir)), sales, ["contract", "amount"])
    return tree.select("rank", "supplier", F.array_join(F.transform("contracts", lambda c: F.concat_ws(":", c["contract"], c["amount"])), ",").alias("contracts"))


company_contracts.sql = f"""WITH {COMPANIES}
SELECT r.rank, r.supplier, coalesce(string_agg(s.contract || ':' || s.amount, ',' ORDER BY s.yr DESC, s.amount DESC, s.contract DESC), '') AS contracts
FROM ranked r LEFT JOIN sales s ON s.supplier = r.supplier GROUP BY r.rank, r.supplier"""


def latest_amendment_with_ties(spark, sf_dir):
    return versions.latest_with_ties(_rows(spark, sf_dir), "contract", "ord", "yr", keep=F.col("supplier") < 22)


latest_amendment_with_ties.sql = f"""WITH {ROWS}, r AS (SELECT *, rank() OVER (PARTITION BY contract ORDER BY ord DESC, yr DESC) AS rk, max(supplier < 22) OVER (PARTITION BY contract) AS keep FROM rows)
SELECT contract, supplier, ord, yr, amount, part, ship FROM r WHERE rk = 1 AND keep"""


def latest_amendment_single(spark, sf_dir):
    return versions.latest_single(_rows(spark, sf_dir), "contract", "ord", "yr", _tie())


latest_amendment_single.sql = f"""WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY {TIE}) AS rn FROM rows)
SELECT contract, supplier, ord, yr, amount, part, ship FROM r WHERE rn = 1"""


def original_first_versions(spark, sf_dir):
    heads = contracts(spark, sf_dir, YEAR).select("contract", "ceiling")
    rows = _rows(spark, sf_dir).join(heads, "contract")
    return versions.original_first(rows, "contract", "ord", "yr", "ceiling").select("contract", "supplier", "ord", "yr", "amount", "part", "ship")


original_first_versions.sql = f"""WITH {ROWS}, c AS (SELECT r.*, max(ord = 0) OVER (PARTITION BY contract) AS has FROM rows r JOIN heads h USING (contract) WHERE year(h.signed) = {YEAR}),
k AS (SELECT *, rank() OVER (PARTITION BY contract ORDER BY ord DESC, yr DESC) AS rk FROM c WHERE ord = 0 OR NOT has)
SELECT contract, supplier, ord, yr, amount, part, ship FROM k WHERE rk = 1"""


def capped_contract_rollup(spark, sf_dir):
    each = _rows(spark, sf_dir).groupBy("contract").agg(F.sum("amount").alias("a")).join(contracts(spark, sf_dir).select("contract", "ceiling"), "contract")
    return each.agg(F.count("*").alias("contract_count"), F.sum(F.least("a", "ceiling")).cast("long").alias("total_amount"), F.count_if(F.col("a") > F.col("ceiling")).alias("capped"))


capped_contract_rollup.sql = f"""WITH {ROWS}, e AS (SELECT contract, sum(amount) AS a, max(ceiling) AS c FROM rows JOIN heads USING (contract) GROUP BY contract)
SELECT count(*) AS contract_count, sum(least(a, c))::BIGINT AS total_amount, count(*) FILTER (a > c) AS capped FROM e"""


def capped_search_summary(spark, sf_dir):
    from ..operators.search import capped_summary

    rows = versions.latest_with_ties(_rows(spark, sf_dir), "contract", "ord", "yr", keep=F.col("supplier") < 22).where("supplier < 22")
    heads = contracts(spark, sf_dir)
    return capped_summary(rows.join(heads.select("contract", "ceiling", "agency"), "contract"), "contract", "amount", "ceiling", "agency", "ship")


capped_search_summary.sql = f"""WITH {ROWS}, r AS (SELECT *, rank() OVER (PARTITION BY contract ORDER BY ord DESC, yr DESC) AS rk FROM rows),
l AS (SELECT r.*, h.ceiling, h.agency FROM r JOIN heads h USING (contract) WHERE rk = 1 AND supplier < 22),
e AS (SELECT contract, sum(amount) AS a, max(ceiling) AS c, max(ship) AS d FROM l GROUP BY contract)
SELECT count(*) AS contract_count, coalesce(sum(least(a, c)), 0)::BIGINT AS total_amount, max(d) AS latest_contract_date, (SELECT count(DISTINCT agency) FROM l) AS notice_linked_count FROM e"""


def summary_of_equal_versions(spark, sf_dir):
    """Rows of a contract's newest version count only where their total is the newest row's too; notices by their identity."""
    from ..functions.identity import notice_identity
    from ..operators.search import capped_summary

    rows = _rows(spark, sf_dir).join(contracts(spark, sf_dir).select("contract", "ceiling", "agency"), "contract").withColumn("stated", F.when(F.col("part") % 5 != 0, F.col("ceiling") + F.col("part") % 2))
    number = F.when(F.col("part") % 3 == 0, F.concat(F.lit(" N"), F.col("agency"), F.lit(" ")))
    rows = rows.withColumn("notice", notice_identity(number, F.when(F.col("part") % 3 == 1, F.concat(F.lit("HTTP://x/"), F.col("agency")))))
    return capped_summary(versions.newest_equal(rows, "contract", "ord", "yr", "stated"), "contract", "amount", "stated", "notice", "ship")


summary_of_equal_versions.sql = f"""WITH {ROWS}, r AS (SELECT *, CASE WHEN part % 5 <> 0 THEN ceiling + part % 2 END AS stated, CASE part % 3 WHEN 0 THEN 'notice:n' || agency WHEN 1 THEN 'notice-url:http://x/' || agency END AS notice FROM rows JOIN heads USING (contract)),
l AS (SELECT *, rank() OVER (PARTITION BY contract ORDER BY ord DESC, yr DESC, stated DESC NULLS LAST) AS rk FROM r),
e AS (SELECT contract, sum(amount) AS a, max(stated) AS c, max(ship) AS d FROM l WHERE rk = 1 GROUP BY contract)
SELECT count(*) AS contract_count, coalesce(sum(least(a, coalesce(c, a))), 0)::BIGINT AS total_amount, max(d) AS latest_contract_date, (SELECT count(DISTINCT notice) FROM l WHERE rk = 1) AS notice_linked_count FROM e"""


def _suppliers(spark, sf_dir, reported: bool) -> DataFrame:
    """One row for each contract and supplier: amount (or null), rate (null), ceiling and current (half of it)."""
    each = _rows(spark, sf_dir).groupBy("contract", "supplier").agg(F.sum("amount").cast("double").alias("amount"))
    each = each if reported else each.withColumn("amount", F.lit(None).cast("double"))
    heads = contracts(spark, sf_dir).select("contract", "ceiling", F.expr("ceiling div 2").alias("current"))
    return each.withColumn("rate", F.lit(None).cast("double")).join(heads, "contract")


def _attributed(rows: DataFrame) -> DataFrame:
    out = attribution.attribute(rows, ["contract"], "supplier", "ceiling", "current")
    return out.select("contract", "supplier", F.col("attributed_total").alias("total"), F.col("attributed_current").alias("current"), "kind")


def equal_share_attribution(spark, sf_dir):
    return _attributed(_suppliers(spark, sf_dir, False))


equal_share_attribution.sql = f"""WITH {ROWS}, s AS (SELECT DISTINCT contract, supplier FROM rows),
t AS (SELECT s.*, ceiling, ceiling // 2 AS cur, count(*) OVER (PARTITION BY contract) AS n, row_number() OVER (PARTITION BY contract ORDER BY supplier) AS k FROM s JOIN heads USING (contract))
SELECT contract, supplier, (ceiling // n + CASE WHEN k <= ceiling % n THEN 1 ELSE 0 END)::DOUBLE AS total, (cur // n + CASE WHEN k <= cur % n THEN 1 ELSE 0 END)::DOUBLE AS current,
  CASE WHEN n = 1 THEN 'full-contract' ELSE 'equal-share' END AS kind FROM t"""


def reported_attribution(spark, sf_dir):
    return _attributed(_suppliers(spark, sf_dir, True))


reported_attribution.sql = f"""WITH {ROWS}, s AS (SELECT contract, supplier, sum(amount)::DOUBLE AS a FROM rows GROUP BY ALL),
t AS (SELECT s.*, ceiling, ceiling // 2 AS cur, count(*) OVER (PARTITION BY contract) AS n, row_number() OVER (PARTITION BY contract ORDER BY supplier) AS k, sum(a) OVER (PARTITION BY contract) <= ceiling AS rep FROM s JOIN heads USING (contract))
SELECT contract, supplier, CASE WHEN rep THEN a ELSE (ceiling // n + CASE WHEN k <= ceiling % n THEN 1 ELSE 0 END)::DOUBLE END AS total,
  CASE WHEN rep THEN CASE WHEN ceiling > 0 THEN cur::DOUBLE * a / ceiling::DOUBLE ELSE 0 END ELSE (cur // n + CASE WHEN k <= cur % n THEN 1 ELSE 0 END)::DOUBLE END AS current,
  CASE WHEN rep THEN 'supplier-reported' WHEN n = 1 THEN 'full-contract' ELSE 'equal-share' END AS kind FROM t"""


def rate_attribution(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("contract"), F.col("l_suppkey").alias("supplier")).agg(F.sum("l_quantity").cast("long").alias("w"))
    rows = li.join(contracts(spark, sf_dir).select("contract", "ceiling"), "contract")
    return attribution.allocate(rows, ["contract"], "supplier", "ceiling", "w", "total").select("contract", "supplier", "total")


rate_attribution.sql = f"""WITH {ROWS}, s AS (SELECT l_orderkey AS contract, l_suppkey AS supplier, sum(l_quantity)::BIGINT AS w FROM lineitem GROUP BY ALL),
t AS (SELECT s.*, ceiling, sum(w) OVER (PARTITION BY contract) AS tw FROM s JOIN heads USING (contract)),
u AS (SELECT *, (ceiling::HUGEINT * w) // tw AS base, (ceiling::HUGEINT * w) % tw AS rest FROM t),
v AS (SELECT *, ceiling - sum(base) OVER (PARTITION BY contract) AS remainder, row_number() OVER (PARTITION BY contract ORDER BY rest DESC, supplier) AS k FROM u)
SELECT contract, supplier, (base + CASE WHEN k <= remainder THEN 1 ELSE 0 END)::BIGINT AS total FROM v"""


def supplier_expansion(spark, sf_dir):
    heads = _rows(spark, sf_dir).groupBy("contract").agg(F.array_sort(F.collect_set("supplier")).alias("s"))
    one = F.transform("s", lambda k: F.struct(k.alias("biz_no"), F.lit("").alias("name"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("double").alias("rate")))
    each = versions.expand_suppliers(heads.select("contract", one.alias("suppliers")).join(contracts(spark, sf_dir).select("contract", "ceiling"), "contract"))
    split = attribution.attribute(each, ["contract"], "position", "ceiling", "ceiling")
    asked = registry_keys(spark, sf_dir).select(F.col("supplier").alias("biz_no"))
    return versions.of_requested(split, asked).select("contract", F.col("biz_no").alias("supplier"), F.col("attributed_total").alias("total"), "kind")


supplier_expansion.sql = f"SELECT contract, supplier, total, kind FROM ({equal_share_attribution.sql}) WHERE supplier < 22"


def origin_in_period(spark, sf_dir):
    from datetime import date

    year = Period("year", YEAR, None, None, date(YEAR, 1, 1), date(YEAR, 12, 31))
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey")
    original = F.when(k % 3 == 0, day)
    order = F.when(k % 4 == 0, F.lit(None).cast("int")).otherwise((k % 3).cast("int"))
    no = F.when(k % 5 == 0, F.lit("N1")).otherwise(F.concat(F.lit("R"), F.substring(day, 3, 2), k))
    passes = overview.origin_in_period(original, order, F.when(k % 7 != 0, day), no, year)
    return o.select("o_orderkey", passes.alias("passes"))


origin_in_period.sql = f"""WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey AS k FROM orders),
y AS (SELECT *, CASE WHEN k % 3 = 0 THEN d END AS og, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 3 END AS ord, CASE WHEN k % 5 = 0 THEN 'N1' ELSE 'R' || substr(d, 3, 2) || k END AS no, CASE WHEN k % 7 <> 0 THEN d END AS dd FROM x)
SELECT o_orderkey, CASE WHEN og IS NOT NULL THEN og BETWEEN '{YEAR}-01-01' AND '{YEAR}-12-31' WHEN coalesce(ord, 0) = 0 THEN dd IS NULL OR dd BETWEEN '{YEAR}-01-01' AND '{YEAR}-12-31'
  WHEN NOT regexp_matches(no, '^R[0-9]{{2}}') THEN true ELSE 2000 + substr(no, 2, 2)::INT = {YEAR} END AS passes FROM y"""


def newer_version_antijoin(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    cached = versions.latest_with_ties(rows.where(F.col("ship") < "1997-01-01"), "contract", "ord", "yr").select("contract", "supplier", "ord", "yr", "amount", "part", "ship")
    latest = versions.latest_with_ties(rows, "contract", "ord", "yr").groupBy("contract").agg(F.max("ord").alias("ord"), F.max("yr").alias("yr"), F.collect_set("supplier").alias("held"))
    return versions.drop_superseded(cached, latest, "contract", "ord", "yr", "supplier", "held")


newer_version_antijoin.sql = f"""WITH {ROWS}, c AS (SELECT *, rank() OVER (PARTITION BY contract ORDER BY ord DESC, yr DESC) AS rk FROM rows WHERE ship < DATE '1997-01-01'),
l AS (SELECT *, rank() OVER (PARTITION BY contract ORDER BY ord DESC, yr DESC) AS rk FROM rows),
n AS (SELECT contract, max(ord) AS o, max(yr) AS y, list(DISTINCT supplier) AS held FROM l WHERE rk = 1 GROUP BY contract)
SELECT c.contract, supplier, ord, yr, amount, part, ship FROM c JOIN n USING (contract) WHERE rk = 1 AND NOT CASE WHEN o <> ord THEN o > ord WHEN y <> yr THEN y > yr ELSE NOT list_contains(held, supplier) END"""


def row_dedupe_fingerprint(spark, sf_dir):
    columns = ["contract", "supplier", "ord", "yr", "amount", "part", "ship"]
    return versions.dedupe(_rows(spark, sf_dir).select(*columns), columns)


row_dedupe_fingerprint.sql = f"WITH {ROWS} SELECT DISTINCT contract, supplier, ord, yr, amount, part, ship FROM rows"


def removed_supplier_groups(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    known = rows.where("supplier < 22").select("contract")
    latest = versions.latest_with_ties(rows, "contract", "ord", "yr")
    return versions.removed_suppliers(latest, "contract", F.col("supplier") < 22, known)


removed_supplier_groups.sql = f"""WITH {ROWS}, l AS (SELECT *, rank() OVER (PARTITION BY contract ORDER BY ord DESC, yr DESC) AS rk FROM rows),
h AS (SELECT contract, max(supplier < 22) AS held FROM l WHERE rk = 1 GROUP BY contract)
SELECT contract FROM h WHERE NOT held AND contract IN (SELECT contract FROM rows WHERE supplier < 22)"""


def workbook_summary(spark, sf_dir):
    return export.summary_sheet(overview.companies(_sales(spark, sf_dir), registry_keys(spark, sf_dir)))


workbook_summary.sql = f"WITH {COMPANIES} SELECT rank, supplier AS company, contract_count, total_amount, latest_date FROM ranked"


def workbook_details(spark, sf_dir):
    sales = _sales(spark, sf_dir).withColumn("kind", export.attribution_label(F.when(F.col("source_rows") > 1, "equal-share").otherwise("full-contract")))
    return export.detail_sheet(sales, overview.companies(sales, registry_keys(spark, sf_dir)), ["contract", "amount", "kind"])


workbook_details.sql = f"WITH {COMPANIES} SELECT r.rank, s.supplier, s.contract, s.amount, CASE WHEN s.source_rows > 1 THEN '균등 추정' ELSE '단독' END AS kind FROM sales s JOIN ranked r USING (supplier)"

QUERIES = [
    company_sales_ranking, overall_sales_totals, source_row_counts, company_contracts, latest_amendment_with_ties, latest_amendment_single, original_first_versions, capped_contract_rollup, capped_search_summary,
    summary_of_equal_versions, equal_share_attribution, reported_attribution, rate_attribution, supplier_expansion, origin_in_period, newer_version_antijoin, row_dedupe_fingerprint, removed_supplier_groups, workbook_summary, workbook_details,
]
