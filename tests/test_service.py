from __future__ import annotations

import json
import logging
import urllib.request

import pytest

from entitylens.build import build
from entitylens.plans.engine import Request
from entitylens.report import measure, render, write
from entitylens.service import JsonLines, RateLimit, Service, ServiceError, serve
from entitylens.store import Store


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("service")
    (folder / "in.jsonl").write_text("\n".join(json.dumps({"id": i, "name": f"N{i}", "description": f"Platform for {['payments', 'smart grids'][i % 2]}", "location": "Norway"}) for i in range(1, 9)))
    report = build(spark, str(folder / "in.jsonl"), str(folder / "store"))
    assert report["read"] == 8 and report["ready"] and report["semantic"]
    return Service(Store(spark, str(folder / "store")), write_keys=("secret",), limit=RateLimit(burst=1000), timeout_s=120)


def test_routes(service):
    ask = lambda method, path, body=None, **h: service.handle(method, path, h, json.dumps(body).encode() if body is not None else b"")
    status, found = ask("POST", "/search", {"query": "payments companies in Norway"})
    assert status == 200 and found["total"] == 4 and found["results"][0]["topics"] == ["payments"] and found["mode"] == "hybrid"
    assert ask("GET", "/search?q=payments&limit=2&mode=keyword")[1]["limit"] == 2
    assert ask("POST", "/search", {"query": ""})[0] == 422 and ask("POST", "/search", {"query": "x", "other": 1})[0] == 422
    assert ask("GET", "/companies/3")[1]["name"] == "N3" and ask("GET", "/companies/99")[0] == 404
    assert len(ask("GET", "/companies/3/similar?limit=3")[1]["results"]) == 3
    assert ask("POST", "/companies", {"name": "New", "description": "lending"})[0] == 401
    key = {"x-api-key": "secret"}
    status, made = ask("POST", "/companies", [{"name": "New", "description": "Platform for lending"}, {"name": ""}], **key)
    assert status == 201 and (made["written"], made["invalid"], made["corpus_size"]) == (1, 1, 9)
    assert ask("GET", "/companies/9")[1]["topics"] == ["lending"]
    assert ask("POST", "/companies/validate", {"name": "", "founded": 1})[1]["records"][0]["error"] == "name must not be empty"
    assert ask("DELETE", "/companies/9", **key)[0] == 200 and ask("DELETE", "/companies/9", **key)[0] == 404
    assert ask("POST", "/admin/reindex", {}, **key)[1]["semantic"]
    assert ask("GET", "/health")[1]["ready"] and ask("GET", "/health/ready")[0] == 200 and ask("GET", "/metrics")[0] == 200
    status, wrong = service.handle("POST", "/search", {"x-request-id": "r1"}, b"{")
    assert status == 422 and wrong["error"]["request_id"] == "r1"
    assert ask("GET", "/nowhere")[0] == 404


def test_http(service):
    server = serve(service, port=0)
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health/live") as r:
            assert json.load(r) == {"status": "alive"}
    finally:
        server.shutdown()


def test_rate_limit():
    now = [0.0]
    limit = RateLimit(per_minute=60, burst=2, clients=2, clock=lambda: now[0])
    limit.check("a"), limit.check("a")
    with pytest.raises(ServiceError) as e:
        limit.check("a")
    assert e.value.status == 429 and e.value.detail == {"retry_after_s": 1.0}
    now[0] = 1.0
    limit.check("a")
    for c in ("b", "c"):
        limit.check(c)
    assert len(limit._buckets) == 2


def test_timeout(spark, service):
    slow = Service(service.store, timeout_s=0.001)
    status, answer = slow.handle("POST", "/search", {}, b'{"query": "payments"}')
    assert status in (200, 504)


def test_report(service, tmp_path):
    r = measure(service.engine, ["payments in Norway", "smart grids"], repeats=1, clients=(1,), calls=2)
    assert r["checks"] == {"questions": 2, "non_empty": 2, "relaxed": 0, "violations": 0}
    write(r, str(tmp_path))
    assert (tmp_path / "report.md").read_text() == render(r) and Request("x").limit == 10


def test_log_lines_are_json():
    record = logging.makeLogRecord({"name": "entitylens", "levelname": "INFO", "msg": "%s", "args": ("request",), "request_id": "r1", "status": 200})
    line = json.loads(JsonLines().format(record))
    assert line["message"] == "request" and line["request_id"] == "r1" and line["status"] == 200 and "args" not in line
