"""HTTP service over an index: health, queries and statistics."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from .operators import toc as T
from .operators.completion import Completer, is_alive
from .plans.retrieve import prepared, retrieve

VERSION = "0.1.0"


class Service:
    """Answers of the endpoints, apart from HTTP; each gives a status and a body.

    What searches need of the index (terms and entries) is made once, when the
    service is, and read by every query.
    """

    def __init__(self, spark: SparkSession, toc: DataFrame | None, completer: Completer | None = None) -> None:
        self.spark, self.toc, self.completer = spark, toc, completer
        self.ready = None if toc is None else prepared(toc)
        self.entries = 0 if toc is None else toc.count()

    def health(self) -> tuple[int, dict]:
        """Healthy if the model answers now; without a model rules answer, which counts as degraded."""
        alive = self.completer is not None and is_alive(self.completer)
        return 200, {"status": "healthy" if alive else "degraded", "llm_connected": alive, "index_loaded": self.toc is not None, "index_entries": self.entries, "version": VERSION}

    def query(self, body: object) -> tuple[int, dict]:
        text = body.get("query") if isinstance(body, dict) else None
        if not isinstance(text, str) or not 1 <= len(text) <= 1000:
            return 422, {"detail": "query must have 1 to 1000 characters"}
        if self.toc is None:
            return 503, {"detail": "No index loaded"}
        asked = self.spark.createDataFrame([(0, text)], "query_id long, query string")
        r = retrieve(asked, self.toc, self.completer, ready=self.ready).first()
        return 200, {"query": text, "answer": r["answer"], "layer_used": r["layer_used"], "success": r["success"], "chunks_used": r["chunks_used"]}

    def stats(self) -> tuple[int, dict]:
        """Name, entries and time of the index; of several, a list of them too."""
        if self.toc is None:
            return 503, {"detail": "No index loaded"}
        rows = [{"source_name": r["source_name"], "entry_count": r["entry_count"], "created_at": str(r["created_at"])} for r in T.stats(self.toc).collect()]
        return 200, {**(rows[0] if len(rows) == 1 else {"entry_count": self.entries}), "indexes": rows}


def serve(service: Service, host: str = "0.0.0.0", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready to run."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            found = {"/health": service.health, "/index/stats": service.stats}.get(self.path)
            self._send(*(found() if found else (404, {"detail": "Not Found"})))

        def do_POST(self) -> None:  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self._send(422, {"detail": "the body is no JSON"})
            if self.path not in ("/query", "/query/stream"):
                return self._send(404, {"detail": "Not Found"})
            status, answer = service.query(body)
            if self.path == "/query" or status != 200:
                return self._send(status, answer)
            self.send_response(200)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()  # without a length: the answer ends with the connection
            for char in answer["answer"] or "":
                self.wfile.write(char.encode())
                self.wfile.flush()
            return None

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
