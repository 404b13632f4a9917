"""Inspection over HTTP, with the standard library: JSON pages and a stream of events."""

from __future__ import annotations

import json
import queue
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from tidemark.operators import inspect as I
from tidemark.operators.inspector import Inspector
from tidemark.streaming.events import HEARTBEAT_SECONDS, Hub, frame

#: The groups under /activities/.
GROUPS = {"pending": "pending", "processing": "processing", "scheduled": "scheduled", "completed": "completed", "cron": "completed_cron", "dead_letter": "dead_letters"}
PARTS = {"events", "steps", "result", "subtree", "children"}


def paging(given: dict[str, list[str]]) -> tuple[int, int]:
    """offset and limit; what isn't a good number is ignored."""

    def number(name: str, default: int, least: int) -> int:
        text = given.get(name, [""])[-1]
        return int(text) if text.isascii() and text.isdigit() and int(text) >= least else default

    return number("offset", 0, 0), min(number("limit", I.PAGE, 1), I.MOST_PAGE)


def answer(inspector: Inspector, path: str, given: dict[str, list[str]], as_id=str) -> tuple[int, object]:
    """Status and body of a GET."""
    offset, limit = paging(given)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a page, or one tree
    parts = [unquote(p) for p in path.strip("/").split("/")]
    match parts:
        case ["stats"]:
            return 200, inspector.stats()
        case ["roots"]:
            status = given.get("status", [""])[-1]
            if status and status not in I.ALL_STATES:
                return 400, {"error": f"unknown status {status}"}
            every = given.get("flatten", [""])[-1] in ("1", "true")
            return 200, rows((inspector.recent if every else inspector.roots)(status or None, offset, limit))
        case ["cron"]:
            return 200, rows(inspector.cron(offset, limit))
        case ["dead-letter"]:
            return 200, rows(inspector.dead_letters(offset, limit))
        case ["activities", group] if group in GROUPS:
            return 200, rows(getattr(inspector, GROUPS[group])(offset, limit))
        case ["activities", key, *more] if not more or (len(more) == 1 and more[0] in PARTS):
            try:
                key = as_id(key)
            except ValueError:
                return 400, {"error": "bad id"}
            part = more[0] if more else None
            if part in (None, "result"):
                found = rows(inspector.activity(key) if part is None else inspector.result(key))
                return (200, found[0]) if found else (404, {"error": "not found"})
            if part == "events":
                return 200, rows(inspector.events(key, limit))
            if part == "children":
                return 200, rows(inspector.children(key, offset, limit))
            return 200, rows(inspector.steps(key) if part == "steps" else inspector.subtree(key))
    return 404, {"error": "not found"}


def serve(inspector: Inspector, hub: Hub | None = None, port: int = 0, as_id=str) -> ThreadingHTTPServer:
    """A server to run with serve_forever()."""

    class Pages(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            url = urlsplit(self.path)
            path = url.path.removeprefix("/api/observability")
            if path == "/stream" and hub is not None:
                return self._stream()
            status, body = answer(inspector, path, parse_qs(url.query), as_id)
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _stream(self):
            try:
                token, rows = hub.subscribe()
            except RuntimeError:
                return self.send_error(503)
            try:
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                while True:
                    try:
                        row = rows.get(timeout=HEARTBEAT_SECONDS)
                    except queue.Empty:
                        row = None
                    self.wfile.write(frame(row).encode())
                    self.wfile.flush()
            except OSError:
                pass  # the reader left
            finally:
                hub.leave(token)

    return ThreadingHTTPServer(("127.0.0.1", port), Pages)
