"""The service's questions over HTTP and over standard input (JSON-RPC, as the Model Context Protocol has it).

Answers are small DataFrames, collected here; the work is Spark's. At most ``most`` requests run at once, the others wait for a bounded time.
"""

from __future__ import annotations

import hmac
import json
import threading
import time
from collections import Counter
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession

from . import __version__, reports, service
from .extractor import Extractor
from .operators.terminology import TerminologyStore

PROTOCOL = "2025-06-18"


class Busy(Exception):
    """No place came free in time."""


class Service:
    """Extractor, store and lexicon of one process, with places for so many requests and what was counted."""

    def __init__(self, spark: SparkSession, extractor: Extractor, lexicon: DataFrame, store: TerminologyStore | None = None, *, most: int = 4, wait: float = 30.0):
        self.spark, self.extractor, self.lexicon, self.store = spark, extractor, lexicon, store
        self.places, self.wait, self.most = threading.BoundedSemaphore(most), wait, most
        self.counts: Counter = Counter()
        self.seconds: list[float] = [0.0] * (len(reports.SECONDS) + 1)
        self.total, self.running, self.guard = 0.0, 0, threading.Lock()

    def count(self, name: str, n: int = 1) -> None:
        with self.guard:
            self.counts[name] += n

    def leased(self, work: Callable[[], Any]) -> Any:
        if not self.places.acquire(timeout=self.wait):
            self.count("refused")
            raise Busy
        began = time.monotonic()
        with self.guard:
            self.running += 1
        try:
            return work()
        finally:
            took = time.monotonic() - began
            with self.guard:
                self.running -= 1
                self.total += took
                self.seconds[next((k for k, b in enumerate(reports.SECONDS) if took <= b), len(reports.SECONDS))] += 1
            self.places.release()

    def extract(self, text: str, doc_id: str = "request") -> dict:
        if not isinstance(text, str) or not text or len(text) > service.MAX_TEXT:
            raise ValueError(f"text must have 1 to {service.MAX_TEXT} characters")
        result = self.leased(lambda: self.extractor.process(self.spark, text, doc_id).drop("doc_seq").first().asDict(recursive=True))
        self.count("documents")
        self.count("mentions", len(result["mentions"] or []))
        return result

    def rows(self, ask: Callable[[], DataFrame]) -> list[dict]:
        return self.leased(lambda: [r.asDict(recursive=True) for r in ask().collect()])

    def need_store(self) -> TerminologyStore:
        if self.store is None:
            raise LookupError("no terminology store is open")
        return self.store

    def info(self) -> dict:
        return {"version": __version__, "config": self.extractor.config.to_dict(), "terminology": self.store.build_info if self.store else None, "places": self.most}

    def metrics(self) -> str:
        """Counters and the histogram of request times, as text."""
        with self.guard:
            lines = [f"notegrain_{k}_total {v}" for k, v in sorted(self.counts.items())]
            running = 0.0
            for bound, n in zip((*reports.SECONDS, "+Inf"), self.seconds, strict=True):
                running += n
                lines.append(f'notegrain_request_seconds_bucket{{le="{bound}"}} {running:g}')
            lines += [f"notegrain_request_seconds_sum {self.total:.6f}", f"notegrain_request_seconds_count {running:g}", f"notegrain_places {self.most}", f"notegrain_places_in_use {self.running}"]
        return "\n".join(lines) + "\n"


def allowed(header: str | None, token: str | None) -> bool:
    """Is this the bearer of the token? Without a token everyone is."""
    return token is None or hmac.compare_digest((header or "").encode(), f"Bearer {token}".encode())


def http_server(what: Service, host: str = "127.0.0.1", port: int = 0, token: str | None = None) -> ThreadingHTTPServer:
    """GET /health, /ready, /info, /metrics and /concepts/CUI; POST /extract. Only health needs no token."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:  # paths may name patients
            return

        def reply(self, status: int, body: Any, kind: str = "application/json") -> None:
            raw = body.encode() if isinstance(body, str) else json.dumps(body, default=str).encode()
            what.count(f"http_{status}")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            if status == 401:
                self.send_header("WWW-Authenticate", "Bearer")
            self.end_headers()
            self.wfile.write(raw)

        def answer(self, find: Callable[[], Any]) -> None:
            if not allowed(self.headers.get("Authorization"), token):
                return self.reply(401, {"error": "a bearer token is needed"})
            try:
                found = find()
            except (ValueError, KeyError, TypeError) as e:
                return self.reply(422, {"error": str(e)})
            except LookupError as e:
                return self.reply(409, {"error": str(e)})
            except Busy:
                return self.reply(503, {"error": "all places are taken"})
            except Exception as e:  # its type only, never its text
                what.count("errors")
                return self.reply(500, {"error": type(e).__name__})
            if found is None:
                return self.reply(404, {"error": "not found"})
            return self.reply(200, found, "text/plain; version=0.0.4" if isinstance(found, str) else "application/json")

        def do_GET(self) -> None:
            path = self.path.split("?")[0].rstrip("/")
            if path == "/health":
                return self.reply(200, {"status": "ok"})
            if path == "/ready":
                return self.answer(lambda: {"status": "ready"} if what.spark.range(1).count() == 1 else None)
            if path in ("/info", "/metrics"):
                return self.answer(what.info if path == "/info" else what.metrics)
            if path.startswith("/concepts/"):
                return self.answer(lambda: what.rows(lambda: service.lookup_concept(what.need_store(), path.rsplit("/", 1)[-1])) or None)
            return self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            def extract() -> dict:
                size = int(self.headers.get("Content-Length") or 0)
                if not 0 < size <= 8 * service.MAX_TEXT:
                    raise ValueError("the body is empty or too long")
                try:
                    said = json.loads(self.rfile.read(size))
                except ValueError:
                    raise ValueError("the body is no JSON") from None
                if not isinstance(said, dict):
                    raise ValueError("the body is no object")
                return what.extract(said.get("text"), str(said.get("doc_id", "request")))

            if self.path.rstrip("/") != "/extract":
                return self.reply(404, {"error": "not found"})
            return self.answer(extract)

    return ThreadingHTTPServer((host, port), Handler)


def _tools(what: Service) -> dict[str, tuple[str, dict, Callable[..., list[dict]]]]:
    text, number = {"type": "string"}, {"type": "integer"}
    return {
        "extract_clinical_concepts": ("Concepts of a text with their assertions", {"text": text, "max_concepts": number}, lambda text, max_concepts=50: what.rows(lambda: service.extract_concepts(what.spark, what.extractor, text, max_concepts))),
        "lookup_cui": ("A concept's codes", {"cui": text}, lambda cui: what.rows(lambda: service.lookup_concept(what.need_store(), cui))),
        "crosswalk_medical_code": ("Codes of another source", {"source": text, "code": text, "target": text}, lambda source, code, target: what.rows(lambda: service.crosswalk_code(what.need_store(), source, code, target))),
        "search_medical_terms": ("Concepts of a term", {"term": text, "max_results": number}, lambda term, max_results=20: what.rows(lambda: service.search_terms(what.lexicon, term, max_results))),
    }


def respond(what: Service, request: dict) -> dict | None:
    """The answer to one JSON-RPC message; None where none is due."""
    method, given, tools = request.get("method"), request.get("params") or {}, _tools(what)
    resources = {"notegrain://info": what.info, "notegrain://metrics": what.metrics}
    optional = {"max_concepts", "max_results"}

    def result() -> Any:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "notegrain", "version": __version__}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": k, "description": d, "inputSchema": {"type": "object", "properties": p, "required": [x for x in p if x not in optional]}} for k, (d, p, _) in tools.items()]}
        if method == "resources/list":
            return {"resources": [{"uri": u, "name": u.rsplit("/", 1)[-1]} for u in resources]}
        if method == "resources/read":
            said = resources[given["uri"]]()
            return {"contents": [{"uri": given["uri"], "text": said if isinstance(said, str) else json.dumps(said, default=str)}]}
        if method == "tools/call":
            _, _, call = tools[given["name"]]
            try:
                return {"content": [{"type": "text", "text": json.dumps(call(**given.get("arguments", {})), default=str)}], "isError": False}
            except (ValueError, LookupError, TypeError, Busy) as e:
                return {"content": [{"type": "text", "text": str(e) or type(e).__name__}], "isError": True}
        raise NotImplementedError(method)

    if "id" not in request:
        return None
    head = {"jsonrpc": "2.0", "id": request["id"]}
    try:
        return head | {"result": result()}
    except NotImplementedError:
        return head | {"error": {"code": -32601, "message": f"no such method: {method}"}}
    except KeyError as e:
        return head | {"error": {"code": -32602, "message": f"missing or unknown: {e.args[0]}"}}


def stdio_server(what: Service, requests: TextIO, answers: TextIO) -> None:
    """One JSON-RPC message a line, until the input ends."""
    for line in requests:
        if not line.strip():
            continue
        try:
            said = json.loads(line)
            answer = respond(what, said) if isinstance(said, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if answer is not None:
            answers.write(json.dumps(answer) + "\n")
            answers.flush()
