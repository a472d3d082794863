"""The HTTP interface on the standard library's server: JSON endpoints and one page."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from importlib.resources import files
from urllib.parse import parse_qs, urlsplit

from .plans.engine import SearchEngine


class Invalid(ValueError):
    """A parameter out of its bounds: answered with 422."""


def _text(query: dict, name: str, most: int, default: str | None = "") -> str | None:
    value = query.get(name, [default])[0]
    if value is None:
        return None
    if len(value) > most or default is not None and not value:
        raise Invalid(f"{name} must have 1 to {most} characters")
    return value


def _number(query: dict, name: str, least: int, most: int, default: int) -> int:
    raw = query.get(name, [str(default)])[0]
    if not re.fullmatch("[+-]?[0-9]{1,9}", raw.strip()) or not least <= int(raw) <= most:
        raise Invalid(f"{name} must be a number from {least} to {most}")
    return int(raw)


def _flag(query: dict, name: str, default: bool) -> bool:
    raw = query.get(name, [str(default)])[0].lower()
    if raw not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
        raise Invalid(f"{name} must be true or false")
    return raw in ("true", "1", "yes", "on")


def respond(engine: SearchEngine, url: str) -> tuple[int, str, bytes]:
    """Status, content type and body for a GET of the URL."""
    parts = urlsplit(url)
    query = parse_qs(parts.query, keep_blank_values=True)
    try:
        if parts.path == "/":
            return 200, "text/html; charset=utf-8", (files(__package__) / "static" / "index.html").read_bytes()
        if parts.path == "/health":
            body: object = {"status": "ok", "documents": engine.stats()["documents"]}
        elif parts.path == "/api/search":
            body = engine.search(_text(query, "q", 200), _text(query, "category", 32, None), _number(query, "limit", 1, 50, 10), _number(query, "offset", 0, 1000, 0), _flag(query, "correct", True))
        elif parts.path == "/api/suggest":
            text = _text(query, "q", 100)
            body = {"query": text, "suggestions": engine.suggest(text, _number(query, "limit", 1, 20, 8))}
        elif parts.path == "/api/categories":
            body = {"categories": [{"name": name, "papers": n} for name, n in engine.category_counts()]}
        elif parts.path == "/api/stats":
            body = engine.stats()
        else:
            return 404, "application/json", b'{"detail": "Not Found"}'
    except Invalid as e:
        return 422, "application/json", json.dumps({"detail": str(e)}).encode()
    return 200, "application/json", json.dumps(body, ensure_ascii=False).encode()


def server(engine: SearchEngine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, kind, body = respond(engine, self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    return ThreadingHTTPServer((host, port), Handler)
