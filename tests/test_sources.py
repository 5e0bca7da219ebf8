import json

import pytest

from tenderline.operators.merge import Snapshot
from tenderline.sources import csv_index, envelope, paged
from tenderline.sources.errors import Incomplete


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_index(spark, tmp_path):
    head = "biz_no,business_name,contract_date,contract_name,total_contract_amount"
    lines = ['123-45-67890,"A, ""q""",2026-01-15,N,"1,200,000"', "", "123,A,2026-01-15,N,", "1234567890,A,20260115,N,", "1234567890,A,2026-01-15,N,1e3", "1234567890,A,2026-01-15", "1234567890,,2026-01-15,N,"]
    rows, errors = csv_index.read_index(spark, write(tmp_path / "a.csv", "﻿" + "\r\n".join([head, *lines]) + "\r\n"))
    (r,) = rows.collect()
    assert (r.biz_no_normalized, r.business_name, r.total_contract_amount, r.biz_no_display) == ("1234567890", 'A, "q"', 1200000, "123-45-67890")
    assert sorted(e.reason for e in errors.collect()) == ["biz_no", "contract_date", "field count", "missing business_name", "total_contract_amount"]
    for bad in ("", "biz_no,biz_no,business_name,contract_date,contract_name\n", "biz_no,business_name\n"):
        with pytest.raises(ValueError):
            csv_index.read_index(spark, write(tmp_path / "b.csv", bad))


def page(items, total=2, code="00"):
    return json.dumps({"response": {"header": {"resultCode": code, "resultMsg": "m"}, "body": {"items": items, "totalCount": total}}})


def test_envelopes(spark):
    pages = [page([{"a": 1}, {"a": "2"}]), page({"item": [{"a": 1}]}), page({"item": {"a": 1}}), page(None), page([], code="07"), "{", json.dumps({"response": {}}), page([], total="x"), json.dumps({"OpenAPI_ServiceResponse": {"cmmMsgHeader": {"returnReasonCode": "30", "returnAuthMsg": "KEY"}}})]
    df = spark.createDataFrame(list(enumerate(pages)), "n int, page string")
    got = {r.n: (len(r["items"]), r.error and r.error.code) for r in envelope.parsed_pages(df).collect()}
    assert got == {0: (2, None), 1: (1, None), 2: (1, None), 3: (0, None), 4: (0, "07"), 5: (0, "json"), 6: (0, "envelope"), 7: (0, "envelope"), 8: (0, "30")}
    assert sorted((r.n, r.row["a"]) for r in envelope.exploded(df).collect()) == [(0, "1"), (0, "2"), (1, "1"), (2, "1")]


def test_paged_source(spark, tmp_path):
    for w, pages in {"w1": [page([{"a": 1}] * 2, 3), page([{"a": 3}], 3)], "w2": [page([], 0)]}.items():
        (tmp_path / w).mkdir()
        for k, text in enumerate(pages, 1):
            write(tmp_path / w / f"{k}.json", text)
    spark.dataSource.register(paged.PagedJson)
    df = spark.read.format("paged_json").option("root", str(tmp_path)).option("windows", "w1,w2").option("pause_s", "0").load()
    assert sorted((r.window, r.page_no, r.n_items) for r in df.collect()) == [("w1", 1, 2), ("w1", 2, 1), ("w2", 1, 0)]
    assert envelope.exploded(df).count() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert spark.read.format("paged_json").option("root", str(tmp_path)).option("windows", "w1,gone").option("pushdown", "true").option("pause_s", "0").load().where("window = 'w1'").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    write(tmp_path / "w2" / "1.json", page([], 5))
    with pytest.raises(Exception, match="empty"):
        spark.read.format("paged_json").option("root", str(tmp_path)).option("windows", "w2").option("pause_s", "0").load().collect()


def test_page_loops():
    totals = iter([3, 5, 4])
    assert paged.growing_pages(lambda k: (next(totals), ["x", "y"] if k < 3 else ["z"])) == [["x", "y"], ["x", "y"], ["z"]]
    assert paged.cumulative_pages(lambda k: (3, ["a", "b"] if k == 1 else ["c"])) == [["a", "b"], ["c"]]
    with pytest.raises(Incomplete):
        paged.cumulative_pages(lambda k: (3, ["a"] if k == 1 else []))
    assert paged.build_url("http://x", {"a": 1, "b": None, "c": " "}) == "http://x?a=1&type=json"


def test_index_quotes_and_line_numbers(spark, tmp_path):
    head = 'biz_no,"business_name",contract_date,contract_name'
    lines = ["", '1234567890,A "x, y" z,2026-01-15,N', "bad", "  ", '1234567891,"B ""q"" c" d,2026-01-15,"no end', "12,A,2026-01-15,N"]
    rows, errors = csv_index.read_index(spark, write(tmp_path / "a.csv", "\n".join(["", head, *lines])))
    assert sorted((r.biz_no_normalized, r.business_name, r.contract_name) for r in rows.collect()) == [("1234567890", "A x, y z", "N"), ("1234567891", 'B "q" c d', "no end")]
    assert sorted((e.line_no, e.reason) for e in errors.collect()) == [(5, "field count"), (8, "biz_no")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        many = [head, *("1234567890,A,2026-01-15,N" if i % 100 else "bad" for i in range(1, 3000))]
        _, errors = csv_index.read_index(spark, write(tmp_path / "b.csv", "\r\n".join(many)))
        assert sorted(e.line_no for e in errors.collect()) == [i + 1 for i in range(100, 3000, 100)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_snapshot_after_a_crash(spark, tmp_path):
    """A write that ends before its manifest is whole changes nothing, and the next one does not touch what counts."""
    table = Snapshot(spark, str(tmp_path / "t"))
    table.write(spark.range(3))
    spark.range(9).write.parquet(str(tmp_path / "t" / "v2-orphan"))
    (tmp_path / "t" / "manifest-2").write_text("")
    assert table.version() == 1 and table.read().count() == 3
    assert table.write(spark.range(4)) == 3 and table.read().count() == 4
    (tmp_path / "t" / "manifest-3").unlink()
    assert table.version() == 1 and table.read().count() == 3
    for n in range(6):
        table.write(spark.range(n))
    assert table.read().count() == 5 and len(list((tmp_path / "t").glob("v*"))) <= 3 + 2


def test_two_writers(spark, tmp_path, monkeypatch):
    one, other = Snapshot(spark, str(tmp_path / "t")), Snapshot(spark, str(tmp_path / "t"))
    one.write(spark.range(1))
    seen = one._versions()
    one.write(spark.range(2))
    monkeypatch.setattr(other, "_versions", lambda: seen)  # it looked before the first had ended
    with pytest.raises(Exception, match="exist"):
        other.write(spark.range(7))
    assert one.read().count() == 2


def test_snapshot(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"))
    assert table.version() == 0
    table.write(spark.range(3))
    table.write(spark.range(5))
    assert table.version() == 2 and table.read().count() == 5
    table.backup(str(tmp_path / "copy"))
    assert Snapshot(spark, str(tmp_path / "copy")).read().count() == 5
