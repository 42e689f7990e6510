"""Requests to a store as method, target and body, answered with a status and JSON text; and a small HTTP server on them."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..errors import BadRequest, StoreClosed
from ..functions.values import parse_cutoff
from ..sources.store import EventStore
from .query import ROUTES, EventQuery, parameters


def _error(status: int, e: Exception) -> tuple[int, str]:
    return status, json.dumps({"error": str(e)}, ensure_ascii=False)


def handle(store: EventStore, method: str, target: str, body: bytes = b"", content_type: str = "") -> tuple[int, str]:
    """Status and JSON text. Wrong requests are refused before anything is read or written."""
    path, _, query = target.partition("?")
    known = {"/health": {"GET"}, "/events/drop": {"POST"}, **{p: {"GET"} for p in ROUTES}}
    known["/events"] = {"GET", "POST"}
    if path not in known:
        return 404, '{"error":"no such path"}'
    if method not in known[path]:
        return 405, '{"error":"no such method here"}'
    try:
        if path == "/health":
            return 200, '{"status":"ok"}'
        if path == "/events/drop":
            if any(name == "in" for name, _ in parameters(query)):
                raise BadRequest("/events/drop has no parameter 'in'")
            store.drop_blocks_before(parse_cutoff(body, content_type))
            return 200, '{"ok":true}'
        if method == "POST":
            n = store.post(body)
            return 201, f'{{"ok":true,"count":{n}}}' if body.lstrip(b" \t\r\n").startswith(b"[") else '{"ok":true}'
        return 200, EventQuery.parse(store.schema, path, query).answer(store)
    except BadRequest as e:
        return _error(400, e)
    except StoreClosed as e:
        return _error(503, e)
    except Exception as e:
        return _error(500, e)


def server(store: EventStore, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server without authentication; call serve_forever() on it. Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, text = handle(store, self.command, self.path, body, self.headers.get("Content-Type") or "")
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
