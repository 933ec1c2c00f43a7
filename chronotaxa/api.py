"""Read-only HTTP: /healthz, /api/checklists, /api/trace?name=, and a plain page at /."""

from __future__ import annotations

import html
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .plans import history
from .plans.store import Store


def respond(store: Store, target: str, cutoff: float = 88.0) -> tuple[int, str, str]:
    """(status, content type, body) of a GET request."""
    url = urlsplit(target)
    name = (parse_qs(url.query, keep_blank_values=True).get("name") or [None])[0]
    if url.path == "/healthz":
        return 200, "application/json", json.dumps({"status": "ok"})
    if url.path == "/api/checklists":
        rows = [r.asDict(recursive=True) for r in history.catalogue(store).collect()]
        return 200, "application/json", json.dumps(rows, default=str, ensure_ascii=False)
    if url.path == "/api/trace":
        if not name:
            return 422, "application/json", json.dumps({"detail": "name must not be empty"})
        return 200, "application/json", json.dumps(history.trace(store, name, cutoff), ensure_ascii=False)
    if url.path == "/":
        body = f"<form><input name=name value='{html.escape(name or '', quote=True)}'></form>"
        if name:
            found = history.trace(store, name, cutoff)
            body += f"<p>{found['tier']}</p>" + "".join(f"<h2>{html.escape(t['name'])}</h2><pre>{html.escape(json.dumps(t, indent=1, ensure_ascii=False))}</pre>" for t in found["traces"])
        return 200, "text/html", f"<!doctype html><meta charset=utf-8>{body}"
    return 404, "application/json", json.dumps({"detail": "not found"})


def serve(store: Store, port: int, cutoff: float) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = respond(store, self.path, cutoff)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
