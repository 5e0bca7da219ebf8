from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from tenderline.functions import amounts, dates, identity, text
from tenderline.operators import attribution, export, mappers, overview, sync, versions


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.select(expr(F.col("c")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_numbers(spark):
    assert column(spark, ["123-45-67890", "12", None], text.business_number) == ["1234567890", None, None]
    assert text.parse_numbers("1234567890, 123-45-67890 0000000001") == ["1234567890", "0000000001"]
    for bad in ("", "12", ",".join(f"{i:010d}" for i in range(51))):
        with pytest.raises(ValueError):
            text.parse_numbers(bad)


def test_unicode_text(spark):
    assert column(spark, ["　Ａ  b ", None], text.canonical_text) == ["a b", ""]
    assert column(spark, ["제3자 단가 계약"], text.compact_text) == ["제3자단가계약"]


def test_supplier_list(spark):
    got = column(spark, ["[1^A^B^Alpha^Kim^KR^50^x^^123-45-67890][2^A^B^^Lee^^^^^999]", "1^A^B^Beta^Kim^1234567891", " ", None], text.supplier_list)
    assert [[(s.name, s.representative, s.biz_no) for s in x] for x in got] == [[("Alpha", "Kim", "1234567890")], [("Beta", "Kim", "1234567891")], [], []]


def test_urls_and_csv(spark):
    assert column(spark, ["http://a/b?bidPbancOrd=01&x=%41", "/b?x=1", "no"], lambda c: text.query_value(c, "bidPbancOrd", "000")) == ["01", "000", "000"]
    assert column(spark, ["https://a", "javascript:x", None], text.safe_url) == ["https://a", None, None]
    assert column(spark, ['a"b', "a,b", "a", None, "a\nb"], text.csv_field) == ['"a""b"', '"a,b"', "a", "", '"a\nb"']
    assert column(spark, ["u?serviceKey=abc&x=1"], text.redacted) == ["u?serviceKey=[REDACTED]&x=1"]


def test_dates(spark):
    v = ["20260115", "2026-02-31", "2026/01/15", "x", None]
    assert column(spark, v, dates.strict_date) == [date(2026, 1, 15), None, date(2026, 1, 15), None, None]
    assert column(spark, v, dates.lenient_date) == ["2026-01-15", "2026-02-31", "2026-01-15", None, None]
    assert column(spark, ["2020-07-31"], lambda c: dates.designation_end(F.to_date(c))) == [date(2026, 7, 30)]


def test_periods():
    now = datetime(2026, 6, 15, 20, tzinfo=UTC)  # the sixteenth in Seoul
    p = dates.period("quarter", 2026, quarter=2, now=now)
    assert (p.date_from, p.date_to, p.label) == (date(2026, 4, 1), date(2026, 6, 16), "2026-Q2")
    assert dates.period("month", 2024, month=2, now=now).date_to == date(2024, 2, 29)
    assert dates.period("year", 2025, now=now).date_to == date(2025, 12, 31)
    for bad in (dict(kind="month", year=2026), dict(kind="year", year=2026, month=1), dict(kind="year", year=2003), dict(kind="month", year=2026, month=7), dict(kind="quarter", year=2025, quarter=5)):
        with pytest.raises(ValueError):
            dates.period(**bad, now=now)


def test_amounts(spark):
    v = ["1,200,000원", "1,23", "-5", "-2.5", "1e3", "", None]
    assert column(spark, v, amounts.amount_strict) == [1200000, None, None, None, None, None, None]
    assert column(spark, v, amounts.amount_loose) == [1200000.0, 123.0, -5.0, -2.5, 13.0, 0.0, 0.0]
    assert column(spark, v, amounts.amount_signed) == [None, 123, -5, -2, None, None, None]
    assert column(spark, v, amounts.won) == [None, 123, -5, -2, 1000, None, None]


def test_largest_remainder_against_fractions(spark):
    import random
    from fractions import Fraction

    random.seed(3)
    cases = {k: (random.randint(0, 10**6), [random.randint(0, 9) for _ in range(random.randint(1, 6))]) for k in range(300)}
    rows = spark.createDataFrame([(k, i, a, w) for k, (a, ws) in cases.items() for i, w in enumerate(ws)], "k int, i int, a long, w long")
    got = {}
    for r in attribution.allocate(rows, ["k"], "i", "a", "w", "x").collect():
        got.setdefault(r.k, {})[r.i] = r.x
    for k, (a, ws) in cases.items():
        total = sum(ws)
        want = [0] * len(ws)
        if total:
            exact = [Fraction(a * w, total) for w in ws]
            want = [int(x) for x in exact]
            for i in sorted(range(len(ws)), key=lambda i: (-(exact[i] - int(exact[i])), i))[: a - sum(want)]:
                want[i] += 1
            assert sum(want) == a
        assert [got[k][i] for i in range(len(ws))] == want


def test_attribution_kinds(spark):
    rows = [(1, 0, "a", 600.0, None, 1000, 500), (1, 1, "b", 400.0, None, 1000, 500), (2, 0, "a", None, None, 1001, 0), (2, 1, "b", None, None, 1001, 0), (3, 0, "a", None, 70.0, 1001, 10), (3, 1, "b", None, 30.0, 1001, 10), (4, 0, "a", None, None, 7, 7)]
    df = spark.createDataFrame(rows, "k int, i int, s string, amount double, rate double, total long, current long")
    got = {(r.k, r.i): (r.attributed_total, r.attributed_current, r.kind) for r in attribution.attribute(df, ["k"], "i", "total", "current").collect()}
    assert got[1, 0] == (600.0, 300.0, "supplier-reported") and got[1, 1] == (400.0, 200.0, "supplier-reported")
    assert got[2, 0] == (501.0, 0.0, "equal-share") and got[2, 1] == (500.0, 0.0, "equal-share")
    assert got[3, 0] == (701.0, 7.0, "supplier-rate") and got[3, 1] == (300.0, 3.0, "supplier-rate")
    assert got[4, 0] == (7.0, 7.0, "full-contract")


def test_versions(spark):
    rows = [("c", None, "2026-01-01", 1, "x"), ("c", 0, "2026-01-01", 1, "y"), ("c", -1, "2026-02-01", 1, "z"), ("d", 1, "2026-01-01", 5, "x"), ("d", 1, "2026-01-01", 5, "y"), ("d", 2, None, 5, "z"), ("e", 1, "2026-01-01", 5, "x"), ("e", 2, "2026-01-01", 5, "z")]
    df = spark.createDataFrame(rows, "k string, o int, d string, t int, s string")
    latest = {(r.k, r.s) for r in versions.latest_with_ties(df, "k", "o", "d").collect()}
    assert latest == {("c", "y"), ("d", "z"), ("e", "z")}
    kept = {r.k for r in versions.latest_with_ties(df, "k", "o", "d", keep=F.col("s") == "x").collect()}
    assert kept == {"c", "d", "e"}
    first = {(r.k, r.s) for r in versions.original_first(df, "k", "o", "d", "t").collect()}
    assert first == {("c", "y"), ("d", "z"), ("e", "z")}


def test_mappers(spark):
    row = {"corpList": "[1^A^B^Alpha^Kim^KR^50^x^^1234567890][2^A^B^Beta^Lee^KR^50^x^^1234567891]", "cntrctCnclsDate": "20260115", "cntrctNm": "N", "totCntrctAmt": "1,000", "cntrctNo": " R1 ", "dminsttList": "[1^D1^Demand]", "prodNm": "P", "cntrctOrd": "1"}
    items = spark.createDataFrame([(1, row), (2, {"사업자등록번호": "123-45-67890", "계약명": "M"})], "n int, row map<string,string>")
    asked = spark.createDataFrame([("1234567890",)], "biz_no string")
    good, bad = mappers.lookup_rows(items, asked)
    (g,) = good.collect()
    assert (g.business_name, g.contract_date, g.total_contract_amount, g.contract_no, g.demand_agency_name) == ("Alpha", date(2026, 1, 15), 1000, "R1", "Demand")
    assert [b.reason for b in bad.collect()] == ["missing business_name, contract_date"]
    p = mappers.projections(items).where("n = 1").first()
    assert (p.contract_key_kind, p.amendment_order, p.total_contract_amount, len(p.suppliers)) == ("contract-no", 1, 1000.0, 2)


def test_identity_classes(spark):
    a = {"b": "1", "a": None}
    rows = spark.createDataFrame([(1, a, '{"x":1,"y":{"b":2,"a":1}}'), (2, {"a": None, "b": "1"}, '{"y":{"a":1,"b":2},"x":1}'), (3, {"a": "", "b": "2"}, "[]")], "i int, m map<string,string>, j string")
    h = [(r[0], r[1]) for r in rows.orderBy("i").select(identity.row_hash(F.col("m")), identity.observation_hash(F.col("j"))).collect()]
    assert h[0] == h[1] and h[0][0] != h[2][0] and h[0][1] != h[2][1]


def test_origin_and_labels(spark):
    p = dates.period("year", 2025, now=datetime(2026, 6, 1, tzinfo=UTC))
    rows = [("2025-03-01", 1, None, "x", True), ("2024-03-01", 0, "2025-01-01", "x", False), (None, 0, "2025-01-01", "x", True), (None, None, None, "x", True), (None, 1, "2020-01-01", "R25x", True), (None, 1, "2025-01-01", "r24x", False), (None, 2, None, "N", True)]
    df = spark.createDataFrame(rows, "o string, n int, d string, no string, want boolean")
    assert df.where(overview.origin_in_period(F.col("o"), F.col("n"), F.col("d"), F.col("no"), p) != F.col("want")).count() == 0
    assert export.file_name(["1"]) == "contracts-1.csv" and export.file_name(["1", "2"]) == "contracts-multi.csv"


def test_adaptive_windows():
    def fetch(w):
        if (w[1] - w[0]).days >= 7:
            raise ValueError("too large")
        if w[0] == date(2026, 1, 8):
            raise RuntimeError("down")
        return w

    got, errors = sync.fetch_all([(date(2026, 1, 1), date(2026, 1, 31))], fetch)
    assert len(got) == 4 and [e[0][0] for e in errors] == [date(2026, 1, 8)]
