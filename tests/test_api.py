import json
from datetime import UTC, date, datetime

import pytest

from tenderline import api
from tenderline.functions import dates
from tenderline.sources.errors import Configuration, Input, Temporary, Unauthorized
from tenderline.sources.registry import SUPPLIERS

HEAD = "biz_no,business_name,contract_date,contract_name,total_contract_amount,notice_no,business_category\n"


def test_import_search_export(spark, tmp_path):
    engine = api.Engine(spark, str(tmp_path / "store"))
    one = tmp_path / "a.csv"
    one.write_text(HEAD + "1234567890,A,2026-01-15,N1,100,X1,goods\n1234567890,A,2026-02-15,N2,,,goods\n1234567891,B,2026-01-20,N3,50,,services\n12,B,2026-01-20,N3,50,,services\n", encoding="utf-8")
    assert engine.import_index(str(one)) == {"inserted": 3, "updated": 0, "errors": 1, "status": "partial"}
    assert engine.import_index(str(one)) == {"inserted": 0, "updated": 3, "errors": 1, "status": "partial"}
    found = engine.search("1234567891 1234567890")
    assert [(r.contract_name, r.business_name, r.place) for r in found.collect()] == [("N3", "B", 0), ("N2", "A", 1), ("N1", "A", 1)]
    assert engine.summary(found).first().asDict() == {"contract_count": 3, "total_amount": 150, "notice_linked_count": 1, "latest_contract_date": "2026-02-15"}
    assert engine.search("1234567890", date(2026, 2, 1)).count() == 1 and engine.search("1234567890", category="services").count() == 0
    assert engine.health().first().row_count == 3
    assert engine.export(str(tmp_path / "out"), "1234567890") == "contracts-1234567890.csv"
    text = spark.read.text(str(tmp_path / "out")).collect()
    assert next((tmp_path / "out").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbf")
    assert len(text) == 3 and text[1][0].startswith("123-45-67890,A,2026-02-15,N2")
    first = engine.records.read().where("contract_name = 'N1'").select("id")
    engine.enrich(first.selectExpr("id", "'method' as contract_method"), ["contract_method"])
    assert engine.records.read().where("source_status = 'api_enriched'").count() == 1


def test_overview(spark):
    a, b = SUPPLIERS[0][1], SUPPLIERS[1][1]
    code = {"dtilPrdctClsfcNo": "39121801-01"}
    both = f"[1^x^x^A^k^KR^x^x^{a}][2^x^x^B^k^KR^x^x^{b}]"
    rows = [
        code | {"corpList": both, "cntrctNo": "R25A", "cntrctCnclsDate": "20250301", "totCntrctAmt": "1001", "cntrctNm": "n"},
        code | {"bizno": a, "cntrctNo": "R25B", "cntrctCnclsDate": "20250401", "totCntrctAmt": "500", "cntrctNm": "n"},
        code | {"bizno": a, "cntrctNo": "R24C", "cntrctCnclsDate": "20250401", "totCntrctAmt": "7", "cntrctNm": "n", "cntrctOrd": "1"},
        {"bizno": a, "cntrctNo": "R25D", "cntrctCnclsDate": "20250401", "totCntrctAmt": "9", "cntrctNm": "n"},
        code | {"bizno": "9999999999", "cntrctNo": "R25E", "cntrctCnclsDate": "20250401", "totCntrctAmt": "11", "cntrctNm": "n"},
    ]
    items = spark.createDataFrame([(r,) for r in rows], "row map<string,string>")
    period = dates.period("year", 2025, now=datetime(2026, 6, 1, tzinfo=UTC))
    companies, overall, sales = api.sales_overview(spark, items, period)
    got = {r.biz_no: (r["rank"], r.contract_count, r.total_amount) for r in companies.collect()}
    assert len(got) == 22 and got[a] == (1, 2, 1001) and got[b] == (2, 1, 500)
    assert overall.select("contract_count", "total_amount").first() == (2, 1501)
    assert sales.count() == 3


def test_versions_of_a_contract_without_numbers(spark):
    """An amendment with a new date ends the original that names the same first date."""
    row = {"bizno": SUPPLIERS[0][1], "dtilPrdctClsfcNo": "3912180101", "cntrctNm": "n", "dminsttNm": "d", "frstCntrctDate": "20250301"}
    rows = [row | {"cntrctCnclsDate": "20250301", "totCntrctAmt": "100"}, row | {"cntrctCnclsDate": "20250501", "totCntrctAmt": "150", "cntrctOrd": "1"}]
    items = spark.createDataFrame([(r,) for r in rows], "row map<string,string>")
    _, overall, _ = api.sales_overview(spark, items, dates.period("year", 2025, now=datetime(2026, 6, 1, tzinfo=UTC)))
    assert overall.select("contract_count", "total_amount").first() == (1, 150)


def test_overview_with_deliveries(spark):
    a = SUPPLIERS[0][1]
    d = {"bizno": a, "dtilPrdctClsfcNo": "3912180101", "cntrctDivNm": "제3자단가계약", "cntrctDlvrDivNm": "납품요구", "fnlCntrctDlvrReqChgOrdYn": "Y", "cntrctDlvrReqDate": "20250701", "cntrctDlvrReqNo": "D1", "prdctAmt": "70", "dminsttNm": "각 수요기관"}
    rows = [d, d, d | {"cntrctDlvrReqNo": "D2", "cntrctDlvrReqDate": "20240701"}, d | {"cntrctDlvrReqNo": "D3", "fnlCntrctDlvrReqChgOrdYn": "N"}, d | {"cntrctDlvrReqNo": "D4", "bizno": "9999999999"}]
    contract = {"bizno": a, "dtilPrdctClsfcNo": "3912180101", "cntrctNo": "R25B", "cntrctCnclsDate": "20250401", "totCntrctAmt": "500", "cntrctNm": "n"}
    frame = lambda some: spark.createDataFrame([(r,) for r in some], "row map<string,string>")
    companies, overall, sales = api.sales_overview(spark, frame([contract]), dates.period("year", 2025, now=datetime(2026, 6, 1, tzinfo=UTC)), frame(rows))
    assert overall.select("contract_count", "total_amount").first() == (2, 570)
    assert companies.where(f"biz_no = '{a}'").select("contract_count", "total_amount").first() == (2, 570)


def pages_of(*items):
    return [json.dumps({"response": {"header": {"resultCode": "00"}, "body": {"items": list(items), "totalCount": len(items)}}})]


def test_sync(spark, tmp_path):
    engine = api.Engine(spark, str(tmp_path / "store"))
    one = {"bizno": "1234567890", "cntrctCorpNm": "A", "cntrctCnclsDate": "20260115", "cntrctNm": "N1", "cntrctNo": "C1", "totCntrctAmt": "5"}
    seen = []

    def fetch(source, window, category):
        seen.append((source, window, category))
        if source == "shopping":
            line = {"cntrctCorpBizno": "1234567890", "cntrctCnclsStleNm": "제3자단가", "corpNm": "A", "dlvrReqNo": "Q1", "dlvrReqNm": "x", "prdctAmt": "7"}
            return pages_of(line | {"dlvrReqRcptDate": "20260110"}, line | {"dlvrReqRcptDate": "20250110"}) if window[0] == date(2026, 1, 10) else []
        if window == (date(2026, 2, 1), date(2026, 2, 20)):
            raise ValueError("the range is too large")
        if window[0] == date(2026, 2, 8):
            raise Temporary("HTTP 500")
        return pages_of(one, one | {"bizno": "9999999999"}) if window[0] == date(2026, 1, 10) else ["{"] if window[0] == date(2026, 2, 1) else []

    got = engine.sync("123-45-67890", date(2026, 1, 10), date(2026, 2, 20), None, fetch)
    assert got == {"pages": 3, "fetched": 4, "matched": 2, "inserted": 2, "updated": 0, "skipped": 2, "errors": 2, "status": "partial"}
    assert [w for s, w, _ in seen if s == "standard"] == [(date(2026, 1, 10), date(2026, 1, 31)), (date(2026, 2, 1), date(2026, 2, 20)), *((date(2026, 2, d), date(2026, 2, min(d + 6, 20))) for d in (1, 8, 15))]
    assert sorted((r.source_name, r.status) for r in spark.read.parquet(engine.runs_path).collect()) == [("shopping", "success"), ("standard", "partial")]
    assert sorted((r.contract_no, r.total_contract_amount) for r in engine.search("1234567890").collect()) == [("C1", 5), ("Q1", 7)]

    def refused(source, window, category):
        if source == "standard":
            raise Unauthorized("key")
        return pages_of(one | {"cntrctNo": category}) if source == "contract-info" else []

    got = engine.sync("1234567890", date(2026, 1, 1), date(2026, 1, 31), "all", refused)
    assert (got["inserted"], got["errors"], got["status"]) == (4, 0, "success")
    notices = spark.createDataFrame([], "notice_no string")
    contracts = spark.createDataFrame([("C1", None, "m")], "contract_no string, unified_contract_no string, contract_method string")
    engine.enrich_from(notices, contracts, spark.createDataFrame([], "notice_no string"), ["contract_method"])
    assert [r.contract_no for r in engine.records.read().where("contract_method = 'm'").collect()] == ["C1"]
    assert engine.logs().count() == 6


def test_parameters():
    now = datetime(2026, 6, 1, tzinfo=UTC)
    assert api.period_of([("period", "month"), ("year", "2026"), ("month", "5")], now).label == "2026-05"
    for bad in ([("period", "year")], [("period", "year"), ("year", "2025"), ("year", "2025")], [("period", "year"), ("year", "x")], [("period", "year"), ("year", "2025"), ("z", "1")], [("period", "year"), ("year", "1999")]):
        with pytest.raises(Input):
            api.period_of(bad, now)
    assert api.storage_path("file:///a/b") == "/a/b" and api.storage_path("hdfs://x/y") == "hdfs://x/y"
    with pytest.raises(Configuration):
        api.storage_path("libsql://x")
    assert api.first_setting(["A", "B"], {"A": " ", "B": "x"}) == "x"
    with pytest.raises(Configuration):
        api.first_setting(["A"], {})
