"""The engine's calls over HTTP, with the standard library's server: JSON in, JSON out."""

from __future__ import annotations

import json
from collections.abc import Callable
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame

from . import logs
from .api import Engine
from .plans import ingest
from .plans.requests import Filters, Request


class Refused(ValueError):
    """What the caller did wrong, and the status that says so."""

    def __init__(self, status: int, what: str) -> None:
        super().__init__(what)
        self.status = status


def listed(frame: DataFrame) -> list[dict[str, Any]]:
    """A frame of a batch's few rows as JSON objects; nulls stay."""
    return [r.asDict(recursive=True) for r in frame.collect()]


def request_of(body: dict[str, Any], query_id: int = 1) -> Request:
    """A request from its JSON. Unknown names and wrong shapes are refused."""
    body = dict(body)
    filters = body.pop("filters", None)
    names = {"defect_name", "question", "process_parameters", "top_k", "enable_rerank", "query_expansion"}
    if unknown := sorted(set(body) - names):
        raise Refused(400, f"unknown fields: {', '.join(unknown)}")
    try:
        kept = None if filters is None else Filters(**{k: tuple(v) if isinstance(v, list) else v for k, v in filters.items() if v is not None})
    except (TypeError, AttributeError) as e:
        raise Refused(400, f"filters: {e}") from e
    if body.get("process_parameters") is not None and not isinstance(body["process_parameters"], dict):
        raise Refused(400, "process_parameters is no object")
    return Request(query_id, filters=kept, **body)


def answer_of(engine: Engine, body: dict[str, Any], packed: bool) -> dict[str, Any]:
    asked = request_of(body)
    answer = engine.query(asked, timed=True)
    out = {"summary": answer.summaries[asked.query_id], "results": listed(answer.results.orderBy("rank")), "evidence": listed(answer.evidence.orderBy("rank")), "themes": listed(answer.themes.orderBy("first_rank")), "hints": [h for r in answer.hints.collect() for h in r["hints"]]}
    out |= {"diagnostics": (listed(answer.diagnostics) or [{}])[0], "timings_ms": answer.timings_ms}
    if packed:
        out["context_text"] = "\n\n".join(f"{r['rank']}. {r['citation']}\n{r['text'] or ''}" for r in out["results"])
    return out


def uploads(content_type: str, body: bytes) -> tuple[list[tuple[str, bytes]], bool]:
    """The files and the flag `force` of a multipart form."""
    form = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    files, force = [], False
    for part in form.iter_parts():
        if (name := part.get_filename()) is not None:
            files.append((name, part.get_payload(decode=True) or b""))
        elif part.get_param("name", header="content-disposition") == "force":
            force = (part.get_payload(decode=True) or b"").strip().lower() in (b"true", b"1")
    return files, force


class Service:
    """What each route does. suffix: the ending that ingested files must have."""

    def __init__(self, engine: Engine, suffix: str = ".pdf") -> None:
        self.engine, self.suffix = engine, suffix
        self.routes: dict[tuple[str, str], Callable[[dict[str, Any]], Any]] = {
            ("GET", "/health"): lambda _: engine.health(), ("GET", "/documents"): lambda _: listed(engine.list_documents()),
            ("POST", "/ingest"): self.ingest, ("POST", "/reindex"): self.reindex,
            ("POST", "/query"): lambda body: answer_of(engine, body, False), ("POST", "/retrieve-context"): lambda body: answer_of(engine, body, True),
        }

    def document(self, doc_id: str) -> dict[str, Any]:
        try:
            row, chunks = self.engine.get_document(doc_id)
        except KeyError as e:
            raise Refused(404, f"no document {doc_id}") from e
        return {"document": row.asDict(recursive=True), "chunks": listed(chunks)}

    def ingest(self, body: dict[str, Any]) -> dict[str, Any]:
        if "files" in body:
            if bad := [n for n, _ in body["files"] if not n.lower().endswith(self.suffix)]:
                raise Refused(400, f"not {self.suffix}: {', '.join(bad)}")
            rows = self.engine.upload(body["files"], body["force"])
        elif body.get("folder_path"):
            rows = self.engine.ingest(body["folder_path"], bool(body.get("force")), f"*{self.suffix}")
        else:
            raise Refused(400, "neither folder_path nor files")
        return ingest.rollup(rows).first().asDict() | {"files": listed(rows)}

    def reindex(self, body: dict[str, Any]) -> dict[str, Any]:
        return self.engine.reindex(body.get("folder_path"), bool(body.get("force", True)), f"*{self.suffix}")

    def call(self, method: str, path: str, body: dict[str, Any]) -> tuple[int, Any]:
        """(status, what is said): 400 for what the engine refuses, 404 for what isn't there."""
        try:
            if (found := self.routes.get((method, path))) is not None:
                return 200, found(body)
            if method == "GET" and path.startswith("/documents/"):
                return 200, self.document(unquote(path.removeprefix("/documents/")))
            return 404, {"detail": f"no {method} {path}"}
        except Refused as e:
            return e.status, {"detail": str(e)}
        except ValueError as e:
            return 400, {"detail": str(e)}


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000, suffix: str = ".pdf") -> ThreadingHTTPServer:
    """A server that isn't started yet: serve_forever() runs it, shutdown() ends it."""
    service = Service(engine, suffix)

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            content, kind = self.rfile.read(int(self.headers.get("Content-Length") or 0)), self.headers.get("Content-Type") or ""
            try:
                if kind.startswith("multipart/"):
                    files, force = uploads(kind, content)
                    body: dict[str, Any] = {"files": files, "force": force}
                else:
                    body = json.loads(content) if content else {}
                    if not isinstance(body, dict):
                        raise ValueError("the body is no object")
                status, said = service.call(self.command, urlsplit(self.path).path, body)
            except ValueError as e:
                status, said = 400, {"detail": str(e)}
            out = json.dumps(said, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = reply

        def log_message(self, format: str, *args: Any) -> None:
            logs.event("http", line=format % args)

    return ThreadingHTTPServer((host, port), Handler)
