"""The engine behind requests: routes, keys, rate limits, time limits, error envelopes.

``Service.handle`` is plain Python and needs no web framework; ``serve`` puts it
behind the standard library's HTTP server. Nothing here runs on executors.
"""

from __future__ import annotations

import hmac
import json
import logging
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from entitylens.operators.filters import Explicit
from entitylens.operators.ingest import enriched, validated
from entitylens.plans.engine import Engine, InvalidRequest, NotFound, Request
from entitylens.sources.companies import RAW_SCHEMA
from entitylens.store import Store

log = logging.getLogger("entitylens")


class JsonLines(logging.Formatter):
    """A log record as one JSON line, with what a caller gave as extra fields."""

    KNOWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}

    def format(self, record: logging.LogRecord) -> str:
        line = {"at": self.formatTime(record, "%Y-%m-%dT%H:%M:%S%z"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in vars(record).items() if k not in self.KNOWN}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def log_json(level: int = logging.INFO) -> None:
    """Writes this package's log to standard error as JSON lines."""
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    log.handlers, log.propagate = [handler], False
    log.setLevel(level)


class ServiceError(Exception):
    def __init__(self, status: int, code: str, message: str, detail: object = None):
        super().__init__(message)
        self.status, self.code, self.message, self.detail = status, code, message, detail

    def envelope(self, request_id: str) -> dict:
        return {"error": {"code": self.code, "message": self.message, "detail": self.detail, "request_id": request_id}}


@dataclass
class TokenBucket:
    """Allows ``burst`` calls at once and ``per_second`` more as time passes."""

    burst: float
    per_second: float
    level: float
    at: float

    def take(self, now: float) -> float:
        """0 if a call may go on, else the seconds to wait."""
        self.level = min(self.burst, self.level + (now - self.at) * self.per_second)
        self.at = now
        if self.level >= 1:
            self.level -= 1
            return 0.0
        return (1 - self.level) / self.per_second


class RateLimit:
    """One bucket for each client; the clients not seen for longest are forgotten."""

    def __init__(self, per_minute: float = 120, burst: int = 30, clients: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.per_second, self.burst, self.most, self.clock = per_minute / 60, burst, clients, clock
        self._buckets: OrderedDict[str, TokenBucket] = OrderedDict()
        self._lock = threading.Lock()

    def check(self, client: str) -> None:
        with self._lock:
            now = self.clock()
            bucket = self._buckets.setdefault(client, TokenBucket(self.burst, self.per_second, self.burst, now))
            self._buckets.move_to_end(client)
            while len(self._buckets) > self.most:
                self._buckets.popitem(last=False)
            wait = bucket.take(now)
        if wait:
            raise ServiceError(429, "rate_limited", "too many requests", {"retry_after_s": round(wait, 3)})


def within(spark: SparkSession, seconds: float, run: Callable[[], object]) -> object:
    """run(), whose Spark jobs are cancelled when the time is up."""
    tag, done = f"request-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        if not done.is_set():
            spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    began = time.monotonic()
    spark.addTag(tag)
    timer.start()
    try:
        return run()
    except ServiceError:
        raise
    except Exception as e:
        if time.monotonic() - began >= seconds:
            raise ServiceError(504, "timeout", f"the request took more than {seconds:g} s") from e
        raise
    finally:
        done.set()
        timer.cancel()
        spark.removeTag(tag)


class Service:
    def __init__(self, store: Store, write_keys: tuple[str, ...] = (), read_keys: tuple[str, ...] = (), limit: RateLimit | None = None, timeout_s: float = 10.0):
        self.store, self.write_keys, self.read_keys = store, write_keys, read_keys
        self.limit, self.timeout_s = limit or RateLimit(), timeout_s
        self._write = threading.Lock()
        self.engine: Engine | None = None
        self.reason: str | None = None
        self.reload()

    def reload(self) -> None:
        """Swaps the engine; requests under way keep the one they began with."""
        self.engine, self.reason = self.store.try_engine()

    # -- access ------------------------------------------------------------

    @staticmethod
    def _key(headers: dict[str, str]) -> str:
        given = headers.get("x-api-key", "")
        auth = headers.get("authorization", "")
        return given or (auth[7:] if auth.lower().startswith("bearer ") else "")

    def _allow(self, keys: tuple[str, ...], headers: dict[str, str]) -> None:
        # Every key is compared, in constant time each.
        if keys and not any([hmac.compare_digest(k.encode(), self._key(headers).encode()) for k in keys]):
            raise ServiceError(401, "unauthorized", "a valid API key is needed")

    def _ready(self) -> Engine:
        if self.engine is None:
            raise ServiceError(503, "not_ready", "no index is loaded", self.reason)
        return self.engine

    # -- routes ------------------------------------------------------------

    def search(self, body: dict) -> dict:
        began = time.perf_counter()
        known = {f.name for f in fields(Request)}
        if extra := set(body) - known:
            raise ServiceError(422, "invalid_request", "unknown fields", sorted(extra))
        explicit = body.get("filters")
        try:
            request = Request(**body | {"filters": Explicit(**explicit) if explicit else None})
            engine = self._ready()
            with engine.metrics.timer("search_ms"):
                r = engine.search(request)
                rows = [x.asDict(recursive=True) for x in r.results.collect()]
        except (InvalidRequest, TypeError) as e:
            raise ServiceError(422, "invalid_request", str(e)) from e
        relaxation = {"applied": r.relaxation.applied, "dropped": list(r.relaxation.dropped), "strict_result_count": r.relaxation.strict_count, "message": r.relaxation.message}
        parsed = {"raw": r.parsed.raw, "notes": list(r.parsed.notes), "text_terms": list(r.parsed.text_terms), "soft_signals": list(r.parsed.soft_signals)}
        return {"query": request.query, "mode": r.mode, "parsed": parsed, "results": rows, "total": r.total, "limit": request.limit, "offset": request.offset, "fallback": r.fallback, "took_ms": round((time.perf_counter() - began) * 1000, 2), "relaxation": relaxation, "timings_ms": r.timings_ms}

    def get(self, key: int) -> dict:
        row = self._ready().get(key).first()
        if row is None:
            raise ServiceError(404, "not_found", f"no entity has id {key}")
        return row.asDict(recursive=True)

    def similar(self, key: int, limit: int = 10, same_industry: bool = False, same_location: bool = False) -> dict:
        if not 1 <= limit <= 100:
            raise ServiceError(422, "invalid_request", "limit must be 1 to 100")
        page, total = self._ready().similar(key, limit, same_industry, same_location)
        return {"seed": self.get(key), "results": [r.asDict(recursive=True) for r in page.collect()], "total": total}

    def _raw(self, payload: object):
        records = payload if isinstance(payload, list) else [payload]
        if not records or not all(isinstance(r, dict) for r in records):
            raise ServiceError(422, "invalid_request", "a record or a list of records is needed")
        names = [f.name for f in RAW_SCHEMA.fields]
        text = lambda v: None if v is None else json.dumps(v) if isinstance(v, (dict, list, bool)) else str(v)
        rows = [tuple(text(r.get(n)) for n in names) + (i,) for i, r in enumerate(records)]
        return self.store.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", _seq long")

    def ingest(self, payload: object, refresh: bool = True) -> dict:
        """New rows are found by words and filters at once, by meaning after the next embedding."""
        with self._write:
            try:
                stats = self.store.ingest(self._raw(payload), live=True)
            except ValueError as e:
                raise ServiceError(413, "too_many", str(e)) from e
            if refresh:
                self.reload()
        return stats | {"semantic_indexed": False, "index_refreshed": refresh}

    def validate(self, payload: object) -> dict:
        """What would be stored, without storing it."""
        checked = enriched(validated(self._raw(payload)))
        return {"records": [r.asDict(recursive=True) for r in checked.orderBy("_seq").drop("_seq").collect()]}

    def delete(self, key: int, refresh: bool = True) -> dict:
        with self._write:
            self.store.delete(key)
            if refresh:
                self.reload()
        return {"deleted": key}

    def reindex(self) -> dict:
        with self._write:
            self.store.embed()
            self.reload()
        return self.store.summary()

    def health(self) -> dict:
        return self.store.summary() | {"loaded": self.engine is not None, "reason": self.reason}

    # -- dispatch ----------------------------------------------------------

    def _route(self, method: str, path: str, query: dict[str, str], headers: dict[str, str], body: object) -> tuple[int, dict]:
        flag = lambda name, default=False: query.get(name, str(default)).lower() in ("1", "true", "yes")
        one = re.fullmatch(r"/companies/(-?\d+)(/similar)?", path)
        if path == "/health":
            return 200, self.health()
        if path == "/health/live":
            return 200, {"status": "alive"}
        if path == "/health/ready":
            return (200, {"status": "ready"}) if self.engine else (503, {"status": "not ready", "reason": self.reason})
        if path == "/metrics":
            return 200, self.engine.metrics.snapshot() if self.engine else {}
        writing = method in ("POST", "DELETE") and path not in ("/search", "/companies/validate")
        self._allow(self.write_keys if writing else self.read_keys, headers)
        if path == "/search" and method == "POST":
            return 200, self.search(body if isinstance(body, dict) else {})
        if path == "/search" and method == "GET":
            asked = {"query": query.get("q", ""), "mode": query.get("mode", "hybrid"), "explain": flag("explain", True)}
            return 200, self.search(asked | {k: int(query[k]) for k in ("limit", "offset") if k in query})
        if one and method == "GET" and one[2]:
            return 200, self.similar(int(one[1]), int(query.get("limit", 10)), flag("same_industry"), flag("same_location"))
        if one and method == "GET":
            return 200, self.get(int(one[1]))
        if one and method == "DELETE" and not one[2]:
            return 200, self.delete(int(one[1]), flag("refresh", True))
        if path == "/companies/validate" and method == "POST":
            return 200, self.validate(body)
        if path == "/companies" and method == "POST":
            return 201, self.ingest(body, flag("refresh", True))
        if path == "/admin/reindex" and method == "POST":
            return 200, self.reindex()
        raise ServiceError(404, "not_found", f"no route {method} {path}")

    def handle(self, method: str, target: str, headers: dict[str, str] | None = None, body: bytes = b"", client: str = "local") -> tuple[int, dict]:
        """Status and JSON answer of a request; every failure has an envelope with the request's id."""
        url, headers = urlsplit(target), {k.lower(): v for k, v in (headers or {}).items()}
        request_id, began = headers.get("x-request-id") or uuid.uuid4().hex, time.perf_counter()
        query = {k: v[-1] for k, v in parse_qs(url.query).items()}
        try:
            if not url.path.startswith("/health"):
                self.limit.check(client)
            try:
                payload = json.loads(body) if body else None
            except ValueError as e:
                raise ServiceError(422, "invalid_request", "the body is not JSON") from e
            run = lambda: self._route(method, url.path, query, headers, payload)
            slow = url.path == "/search" or url.path.endswith("/similar")
            status, answer = within(self.store.spark, self.timeout_s, run) if slow else run()
        except ServiceError as e:
            status, answer = e.status, e.envelope(request_id)
        except NotFound as e:
            status, answer = 404, ServiceError(404, "not_found", str(e)).envelope(request_id)
        except ValueError as e:
            status, answer = 422, ServiceError(422, "invalid_request", str(e)).envelope(request_id)
        except Exception:
            log.exception("request failed", extra={"request_id": request_id})
            status, answer = 500, ServiceError(500, "internal", "the request failed").envelope(request_id)
        log.info("request", extra={"request_id": request_id, "method": method, "path": url.path, "status": status, "ms": round((time.perf_counter() - began) * 1000, 2)})
        return status, answer


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A running HTTP server; call shutdown() to stop it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("content-length") or 0))
            status, answer = service.handle(self.command, self.path, dict(self.headers), body, self.client_address[0])
            data = json.dumps(answer, default=str).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer  # noqa: N815

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


