"""Requests as plain JSON in and out, and the web front of it.

`Service.update` is the whole protocol.  A service is also an ASGI application,
has a WSGI one, and can be mounted into another application of either kind; the
small server of its own only moves bytes.  Its memories are given to it, so any
`CacheBackend` can stand behind it.
"""

from __future__ import annotations

import asyncio
import datetime as dt
import json
import math
import threading
from collections import defaultdict
from decimal import Decimal
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl

from ..sources.registry import REGISTRY, SourceRegistry
from . import codec
from .cache import CacheBackend, cube_cache, delta_cache
from .engine import Engine, TraceInfo
from .spec import ActiveSource, DashboardSpec, InteractionEvent, VisualizationSpec, decode, encode, from_dict, to_dict
from .traces import from_spec

def plain(x: Any) -> Any:
    """JSON data: times as ISO texts, NaN and infinities as null; a TypeError for anything else unknown."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if x is None or isinstance(x, (str, int, bool)):
        return x
    raise TypeError(f"{type(x).__name__} has no JSON form")


def _figures(spec: VisualizationSpec | DashboardSpec) -> list:
    return spec.figures if isinstance(spec, DashboardSpec) else [spec.figure]


def viewports(spec: VisualizationSpec | DashboardSpec) -> dict[str, dict[str, Any]]:
    """Views by figure.  A key is figure/axis, or a bare axis that holds for every figure."""
    out: dict[str, dict[str, Any]] = {f.uid: {} for f in _figures(spec)}
    for key, value in spec.state.viewport.items():
        figure, slash, axis = key.partition("/")
        value = (value["min"], value["max"]) if isinstance(value, dict) and {"min", "max"} <= set(value) else value
        for uid in [figure] if slash else list(out):
            if value is not None and uid in out:
                out[uid][axis if slash else key] = value
    return out


def _scoped(event: InteractionEvent, figures: list) -> list:
    """A viewport or reset event of one figure concerns that figure alone."""
    return [f for f in figures if f.uid == event.figure_uid] if event.figure_uid is not None and event.type in ("viewport", "reset") else figures


def parse(body: dict[str, Any]) -> tuple[VisualizationSpec | DashboardSpec, InteractionEvent]:
    spec = from_dict(DashboardSpec if "figures" in body["spec"] else VisualizationSpec, body["spec"])
    return spec, from_dict(InteractionEvent, body["event"])


def share(spec: dict[str, Any]) -> str:
    return encode(spec)


def view(text: str) -> dict[str, Any]:
    return to_dict(decode(text))


class Service:
    """Sources, the memories of what was computed of them, and the requests that they answer."""

    def __init__(self, registry: SourceRegistry = REGISTRY, deltas: CacheBackend | None = None, cubes: CacheBackend | None = None):
        self.registry = registry
        self.use(delta_cache() if deltas is None else deltas, cube_cache() if cubes is None else cubes)
        registry.on_change.append(self.forget)

    def use(self, deltas: CacheBackend | None = None, cubes: CacheBackend | None = None) -> None:
        """Puts other memories behind the service."""
        self.deltas, self.cubes = (getattr(self, name) if new is None else new for name, new in (("deltas", deltas), ("cubes", cubes)))

    def forget(self, _source: str | None = None) -> None:
        self.deltas.clear()
        self.cubes.clear()

    def update(self, body: dict[str, Any]) -> dict[str, Any]:
        """{spec, event[, active_source, request_cube]} -> {deltas: figure uid -> list}, plus a cube bundle if one is asked for."""
        spec, event = parse(body)
        figures = _figures(spec)
        views = viewports(spec)
        by_source: dict[str, list] = defaultdict(list)
        for f in figures:
            if f.source is not None:
                by_source[f.source].append(f)
        out: dict[str, Any] = {"deltas": {f.uid: [] for f in figures}}
        for name, mine in by_source.items():
            source = self.registry.get(name)
            engine = Engine(source, self.deltas if source.cache else None)
            infos = {f.uid: [TraceInfo(t.uid, f.uid, from_spec(t)) for t in f.traces] for f in mine}
            if event.type == "cube_request":
                active = from_dict(ActiveSource, body["active_source"])
                if body.get("request_cube", True) and source.cache and any(f.uid == active.figure_uid for f in mine):
                    blobs, served = engine.build_cubes([i for f in mine for i in infos[f.uid]], views, event.selections or spec.state.selections, active, self.cubes)
                    out["bundle"], out["trace_cubes"] = codec.encode_bundle(blobs, served), served
                continue
            wanted = [i for f in _scoped(event, mine) for i in infos[f.uid]]
            owner = {i.uid: i.figure_uid for i in wanted}
            for delta in engine.process(event, wanted, views, spec.state.cross_filter_mode):
                out["deltas"][owner[delta.uid]].append(plain(to_dict(delta)))
        return out

    def _get(self, path: str, query: dict[str, str]) -> Any:
        if path == "/sources":
            return self.registry.names()
        if path == "/cache/stats":
            return {name: memory.stats() if hasattr(memory, "stats") else {} for name, memory in (("deltas", self.deltas), ("cubes", self.cubes))}
        if path == "/view":
            return view(query["spec"])
        raise KeyError(path)

    def _post(self, path: str, body: Any) -> Any:
        if path == "/share":
            return {"spec": share(body)}
        if path in ("/update", "/dashboard/update"):
            got = self.update(body)
            return got["bundle"] if "bundle" in got else got
        raise KeyError(path)

    def answer(self, method: str, path: str, query: str, raw: bytes, packed: bool) -> tuple[int, list[tuple[str, str]], bytes]:
        """Status, headers and body of a request; `packed` tells that the client takes gzip."""
        status, kind = 200, "application/json"
        try:
            if method not in ("GET", "POST"):
                raise KeyError(f"{method} {path}")
            got = self._get(path, dict(parse_qsl(query))) if method == "GET" else self._post(path, json.loads(raw))
            if isinstance(got, bytes):
                body, kind = got, "application/octet-stream"
            else:
                body = json.dumps(got).encode()
        except KeyError as e:
            status, body = 404, json.dumps({"error": str(e)}).encode()
        except (ValueError, TypeError) as e:
            status, body = 422, json.dumps({"error": str(e)}).encode()
        if packed:
            body = codec.compressed(body)
        return status, [("Content-Type", kind), *([("Content-Encoding", "gzip")] if packed else []), ("Content-Length", str(len(body)))], body

    async def __call__(self, scope: dict[str, Any], receive, send) -> None:
        """The ASGI application; requests run in threads, so the loop stays free while Spark works."""
        if scope["type"] == "lifespan":
            while (await receive())["type"] != "lifespan.shutdown":
                await send({"type": "lifespan.startup.complete"})
            await send({"type": "lifespan.shutdown.complete"})
            return
        raw, more = b"", True
        while more:
            message = await receive()
            raw, more = raw + message.get("body", b""), message.get("more_body", False)
        headers = dict(scope.get("headers", []))
        path = scope["path"].removeprefix(scope.get("root_path", "")) or "/"
        status, given, body = await asyncio.to_thread(self.answer, scope["method"], path, scope.get("query_string", b"").decode(), raw, b"gzip" in headers.get(b"accept-encoding", b""))
        await send({"type": "http.response.start", "status": status, "headers": [(k.lower().encode(), v.encode()) for k, v in given]})
        await send({"type": "http.response.body", "body": body})

    def wsgi(self, environ: dict[str, Any], start_response) -> list[bytes]:
        """The WSGI application."""
        raw = environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)) if environ["REQUEST_METHOD"] == "POST" else b""
        status, given, body = self.answer(environ["REQUEST_METHOD"], environ.get("PATH_INFO", ""), environ.get("QUERY_STRING", ""), raw, "gzip" in environ.get("HTTP_ACCEPT_ENCODING", ""))
        start_response(f"{status} {HTTPStatus(status).phrase}", given)
        return [body]

    def mount_into(self, host: Any, prefix: str = "/lumenframe") -> Any:
        """Puts the service under a prefix of another application, and returns that.

        An application with `mount` (ASGI frameworks) mounts it itself; a WSGI
        one, or a framework's object that holds one as `wsgi_app`, is wrapped.
        """
        prefix = "/" + prefix.strip("/")
        if hasattr(host, "mount"):
            host.mount(prefix, self)
            return host
        inner = getattr(host, "wsgi_app", host)
        if not callable(inner):
            raise TypeError(f"nothing can be mounted into {type(host).__name__}")

        def dispatch(environ, start_response):
            path = environ.get("PATH_INFO", "")
            if path == prefix or path.startswith(prefix + "/"):
                return self.wsgi({**environ, "SCRIPT_NAME": environ.get("SCRIPT_NAME", "") + prefix, "PATH_INFO": path[len(prefix) :]}, start_response)
            return inner(environ, start_response)

        if inner is host:
            return dispatch
        host.wsgi_app = dispatch
        return host

    def serve(self, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
        """A server in a background thread; `server_address` tells the port, `shutdown` ends it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _reply(self) -> None:
                path, _, query = self.path.partition("?")
                raw = self.rfile.read(int(self.headers.get("Content-Length", 0)))
                status, given, body = service.answer(self.command, path, query, raw, "gzip" in self.headers.get("Accept-Encoding", ""))
                self.send_response(status)
                for name, value in given:
                    self.send_header(name, value)
                self.end_headers()
                self.wfile.write(body)

            do_GET = do_POST = _reply

            def log_message(self, *args: Any) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


#: The service over the registered sources.
app = Service()
handle_update, mount_into, serve = app.update, app.mount_into, app.serve
