import json
import threading

import pytest

from tenderline import __main__ as command
from tenderline import api
from tenderline.operators import runs
from tenderline.sources.errors import Incomplete, Response, Unauthorized


def test_page_budget():
    budget, seen = runs.PageBudget(5), []

    def fetch(w, most):
        seen.append((w, most))
        return [w] * min(most, 3)

    assert budget.windows(["a", "b"], fetch) == [["a"] * 3, ["b"] * 2]
    assert seen == [("a", 4), ("b", 2)] and budget.left == 0
    with pytest.raises(Incomplete):
        budget.windows(["c"], fetch)
    with pytest.raises(Incomplete):
        runs.PageBudget(2).windows(["a"], lambda w, most: [w] * 3)
    assert runs.PageBudget(1).windows([], fetch) == []


def test_time_budget():
    now = [0.0]

    def lookup(key, left):
        now[0] += 4
        if key == "slow":
            raise TimeoutError
        return left

    assert runs.within(["a", "b", "a", "c", "d"], lookup, 10, lambda: now[0]) == ({"a": 10, "b": 6, "c": 2}, 1)
    assert runs.within(["a", "slow", "b"], lookup, 100, lambda: now[0]) == ({"a": 100}, 2)
    assert runs.within([], lookup) == ({}, 0)


def test_single_flight():
    flight, began, go, out, calls = runs.SingleFlight(), threading.Event(), threading.Event(), [], []

    def slow():
        calls.append(1)
        began.set()
        go.wait(10)
        return object()

    first = threading.Thread(target=lambda: out.append(flight("k", slow)))
    first.start()
    assert began.wait(10)
    others = [threading.Thread(target=lambda: out.append(flight("k", slow))) for _ in range(3)]
    for t in others:
        t.start()
    assert flight("other", lambda: 2) == 2
    while flight._running and sum(t.is_alive() for t in others) < 3:
        pass
    go.set()
    for t in [first, *others]:
        t.join(10)
    assert len(out) == 4 and len(set(map(id, out))) == len(calls)
    for _ in range(2):  # an error is given and forgotten
        with pytest.raises(ZeroDivisionError):
            flight("k", lambda: 1 // 0)
    assert flight("k", lambda: 3) == 3


def test_until_complete():
    answers = iter(range(100))
    assert runs.until_complete(lambda: next(answers), lambda x: x == 2) == (2, True)
    now = iter(range(0, 1000, 100))
    assert runs.until_complete(lambda: next(answers), lambda x: False, 250, lambda: next(now)) == (5, False)


def test_answers():
    refused, other = ("w", Unauthorized("Key at http://x?serviceKey=abc&y=1")), ("w", Response("bad"))
    assert runs.answer("failed", [other, refused]) == (403, ["bad", "Key at http://x?serviceKey=[REDACTED]&y=1"], "standard")
    assert runs.answer("failed", [("w", Unauthorized("Shopping Mall refuses"))])[2] == "shopping"
    assert runs.answer("partial", [refused])[::2] == (200, None) and runs.answer("failed", [other])[::2] == (200, None)
    assert runs.answer("success", []) == (200, [], None)
    assert api.Engine.flags({"DATA_GO_KR_SERVICE_KEY": " ", "ENRICHMENT_ENABLED": "TRUE"}) == {"key_configured": False, "enrichment_enabled": False}
    assert runs.flags({"DATA_GO_KR_SERVICE_KEY": "k", "ENRICHMENT_ENABLED": "true"}) == {"key_configured": True, "enrichment_enabled": True}


def test_commands(spark, tmp_path, capsys):
    def run(*args):
        code = command.main([*args], spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    root = str(tmp_path / "store")
    assert run("init", "--root", root) == (0, {"created": ["contract_records", "businesses"]})
    assert run("init", "--root", root) == (0, {"created": []})
    engine = api.Engine(spark, root)
    assert engine.records.read().count() == 0 and engine.search("1234567890").count() == 0
    index = tmp_path / "a.csv"
    index.write_text("biz_no,business_name,contract_date,contract_name\n1234567890,A,2026-01-15,N1\n", encoding="utf-8")
    assert run("import", str(index), "--root", root) == (0, {"inserted": 1, "updated": 0, "errors": 0, "status": "success"})
    engine.records.read().selectExpr("id", "'m' AS contract_method").write.parquet(str(tmp_path / "found"))
    assert run("enrich", str(tmp_path / "found"), "--root", root) == (0, {"logged": 1})
    assert [r.contract_method for r in engine.records.read().collect()] == ["m"] and engine.logs().count() == 1
    index.write_text("biz_no,business_name,contract_date,contract_name\n12,A,2026-01-15,N1\n", encoding="utf-8")
    assert run("import", str(index), "--root", root)[0] == 1
