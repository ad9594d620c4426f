"""The service over HTTP, with the standard library's server: /api/stats, /api/noticias, /api/search, /api/analyze,
/api/export/csv and /health. Errors are JSON: 400 for a bad query, 404 for no data or an unknown path, 500 otherwise."""

from __future__ import annotations

import json
import logging
import os
import tempfile
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from ..operators.search import InvalidQuery
from .service import NoData, Service

log = logging.getLogger("tidewire")


def make_server(service: Service, articles: Callable[[], DataFrame], host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that answers from ``service``; ``articles`` gives what /api/analyze analyses. Port 0 takes a free one."""

    exports = tempfile.TemporaryDirectory()  # gone with the server

    def answer(path: str, args: dict[str, str]) -> dict | str:
        if path == "/api/stats":
            return service.stats()
        if path == "/api/noticias":
            return service.page(int(args.get("page", 1)), int(args.get("per_page", 10)), args.get("only_nna", "").lower() == "true")
        if path == "/api/search":
            return service.search(args.get("q", ""))
        if path == "/api/analyze":
            return {"status": "success", "stats": service.analyze(articles())}
        if path == "/api/export/csv":
            return service.export_csv(os.path.join(exports.name, "noticias_nna.csv"))  # sent by this very process
        if path == "/health":
            return service.health()
        raise NoData("not found")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            try:
                found, code = answer(url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}), 200
            except NoData as e:
                found, code = {"error": str(e)}, 404
            except InvalidQuery as e:
                found, code = {"error": str(e)}, 400
            except Exception as e:  # noqa: BLE001
                log.exception(self.path)
                found, code = {"error": str(e)[:500]}, 500
            if isinstance(found, str):
                with open(found, "rb") as f:
                    body = f.read()
                self._send(code, body, "text/csv", {"Content-Disposition": f"attachment; filename={os.path.basename(found)}"})
            else:
                self._send(code, json.dumps(found, ensure_ascii=False, default=str).encode(), "application/json", {})

        do_POST = do_GET

        def _send(self, code: int, body: bytes, kind: str, more: dict[str, str]) -> None:
            self.send_response(code)
            for k, v in {"Content-Type": f"{kind}; charset=utf-8", "Content-Length": str(len(body)), **more}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, format: str, *args) -> None:
            log.info(format, *args)

    return ThreadingHTTPServer((host, port), Handler)
