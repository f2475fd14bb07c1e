"""JSON requests against an engine: the routes as a plain function, and a small HTTP server over it.

Concurrent upserts of a namespace that arrive within ``WINDOW`` seconds become one commit, and a namespace whose log
has grown enough is indexed in the background.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import logging
import re
import threading
import time
from concurrent.futures import Future
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .api import Engine, Namespace
from .errors import EngineError, refuse
from .validate import check_batch, check_name

#: Seconds that the first upsert of a group waits for others.
WINDOW = 0.05
#: Rows of a group; later requests start the next one.
GROUP_ROWS = 50_000
_log = logging.getLogger(__name__)
_PATH = re.compile(r"/v1/namespaces/([^/]+)(?:/([a-z]+)(?:/(.+))?)?")


class WriteGroups:
    """Group commit: requests of one namespace that come close together are written as one batch, in order of arrival."""

    def __init__(self, namespace: Namespace, window: float = WINDOW):
        self.namespace, self.window = namespace, window
        self.lock = threading.Lock()
        self.waiting: list[tuple[list[dict], str | None, Future]] = []

    def upsert(self, rows: list[dict], metric: str | None = None) -> dict:
        """Like ``Namespace.upsert``; a request is checked before it joins a group, so it cannot spoil one."""
        rows = check_batch(rows)
        dim = self.namespace.store.state()["dim"]
        self.namespace.checked(rows, dim)
        done: Future = Future()
        with self.lock:
            first = not self.waiting
            self.waiting.append((rows, metric, done))
        if first:
            time.sleep(self.window)
            with self.lock:
                group, self.waiting = self.waiting, []
            self._write(group)
        return done.result()

    def _write(self, group: list[tuple[list[dict], str | None, Future]]) -> None:
        dims = {len(rows[0]["vector"]) for rows, _, _ in group}
        whole = sum(len(rows) for rows, _, _ in group)
        if len(group) > 1 and len(dims) == 1 and all(m is None for _, m, _ in group) and whole <= GROUP_ROWS:
            try:
                created = self.namespace.upsert([r for rows, _, _ in group for r in rows], limit=None)["created"]
                for rows, _, done in group:
                    done.set_result({"upserted": len(rows), "created": created})
                return
            except EngineError:
                pass  # one by one below, so that only the request at fault is refused
        for rows, metric, done in group:
            try:
                done.set_result(self.namespace.upsert(rows, metric))
            except Exception as e:
                done.set_exception(e)


class Gateway:
    def __init__(self, engine: Engine, api_key: str | None = None, auto_index: bool = True):
        self.engine, self.api_key, self.auto_index = engine, api_key, auto_index
        self.lock = threading.Lock()
        self.groups: dict[str, WriteGroups] = {}

    def handle(self, method: str, target: str, body: str | bytes = "", authorization: str | None = None) -> tuple[int, dict]:
        """(status, response) of one request; never raises."""
        try:
            return 200, self._route(method.upper(), urlsplit(target), body, authorization)
        except EngineError as e:
            return e.status, {"error": str(e)}
        except Exception as e:
            return 500, {"error": f"{type(e).__name__}: {e}"[:500]}

    def _route(self, method: str, target, body: str | bytes, authorization: str | None) -> dict:
        path = target.path
        if path == "/" and method == "GET":
            return {"name": "lodestone", "version": self.engine.version}
        if path.startswith("/v1/"):
            self._authorise(authorization)
        if path == "/v1/namespaces" and method == "GET":
            return {"namespaces": self.engine.list_namespaces()}
        parts = _PATH.fullmatch(path)
        if not parts:
            refuse("there is nothing at this path", 404)
        name = check_name(unquote(parts[1]))
        ns, action, row_id = self.engine.namespace(name), parts[2], parts[3]
        options = {k: v[-1] for k, v in parse_qs(target.query, keep_blank_values=True).items()}
        if row_id is not None:
            if (method, action) != ("GET", "rows"):
                refuse("there is nothing at this path", 404)
            return ns.get_one(unquote(row_id), options.get("include_vectors") == "true")
        match method, action:
            case "GET", None:
                return ns.stats()
            case "PUT", None:
                return {"name": name, **ns.configure(_object(body).get("distance_metric"))}
            case "DELETE", None:
                return {"name": name, **ns.destroy()}
            case "GET", "rows":
                return ns.list(options.get("cursor"), _number(options.get("limit", "100")))
            case "POST", "index":
                return ns.build_index(_object(body, optional=True).get("force") is not False)
            case "POST", "upsert" | "patch" | "delete" | "rows" | "query":
                return getattr(self, f"_{action}")(ns, _object(body))
        refuse("there is nothing at this path", 404)

    def _authorise(self, authorization: str | None) -> None:
        if not self.api_key:
            refuse("this gateway was started without an API key, so it serves nobody", 500)
        given = (authorization or "").removeprefix("Bearer ") if (authorization or "").startswith("Bearer ") else ""
        a, b = (hashlib.sha256(x.encode()).digest() for x in (given, self.api_key))
        if not hmac.compare_digest(a, b):
            refuse("the API key is missing or wrong", 401)

    def _upsert(self, ns: Namespace, body: dict) -> dict:
        with self.lock:
            group = self.groups.setdefault(ns.store.name, WriteGroups(ns))
        done = group.upsert(body.get("rows"), body.get("distance_metric"))
        if self.auto_index:
            threading.Thread(target=self._index, args=(ns,), daemon=True).start()
        return {"upserted": done["upserted"]}

    def _index(self, ns: Namespace) -> None:
        """A failed background build leaves the namespace as it was; the next write tries again."""
        try:
            ns.maybe_build()
        except Exception:
            _log.exception("background index build of %s failed", ns.store.name)

    def _patch(self, ns: Namespace, body: dict) -> dict:
        return ns.patch(body.get("rows"))

    def _delete(self, ns: Namespace, body: dict) -> dict:
        if body.get("ids"):
            return ns.delete(body["ids"])
        if body.get("filters"):
            return ns.delete(filters=body["filters"])
        refuse("nothing says which rows to delete: give ids, or a filter")

    def _rows(self, ns: Namespace, body: dict) -> dict:
        return {"rows": ns.get(body.get("ids"), body.get("include_vectors") is True)}

    def _query(self, ns: Namespace, body: dict) -> dict:
        known = ("vector", "top_k", "filters", "include_attributes", "include_vectors", "distance_metric", "nprobe")
        return ns.query(**{"vector": None} | {k: body[k] for k in known if k in body})


def _object(body: str | bytes, optional: bool = False) -> dict:
    text = body.decode() if isinstance(body, bytes) else body
    if not text:
        return {} if optional else refuse("the request has no body")
    try:
        found = json.loads(text)
    except ValueError:
        refuse("the body cannot be read as JSON")
    return found if isinstance(found, dict) else refuse("the body is JSON but no object")


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return float("nan")


def server(gateway: Gateway, host: str = "127.0.0.1", port: int = 8787) -> ThreadingHTTPServer:
    """An HTTP server over the gateway; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = gateway.handle(self.command, self.path, body, self.headers.get("Authorization"))
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_PUT = do_POST = do_DELETE = _answer

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
