"""The engine over HTTP: POST a JSON object to a path, get a JSON object back.  python -m lodestone HOME api [PORT]

/parse-project {root}, /parse-file {path, content}, /preprocess-chunks, /embed-chunks, /index-chunks,
/enrich-chunks, /batch-prompts {path, out, form}, /api/index-embedded {path}, /api/hybrid-setup,
/retrieve {questions, most}; GET / names the tables and their rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lodestone.engine import Engine


def counted(table) -> dict:
    return {"rows": None if table is None else table.count()}


ROUTES: dict[str, Callable[[Engine, dict], dict]] = {
    "/parse-project": lambda engine, given: counted(engine.ingest(given["root"])),
    "/parse-file": lambda engine, given: {"chunks": engine.parse_file(given["path"], given["content"])},
    "/preprocess-chunks": lambda engine, given: counted(engine.preprocess()),
    "/embed-chunks": lambda engine, given: counted(engine.embed()),
    "/index-chunks": lambda engine, given: counted(engine.index()),
    "/enrich-chunks": lambda engine, given: counted(engine.enrich()),
    "/batch-prompts": lambda engine, given: counted(engine.batch(given["path"], given["out"], given.get("form", "json"))),
    "/api/index-embedded": lambda engine, given: counted(engine.index_embedded(given["path"])),
    "/api/hybrid-setup": lambda engine, given: counted(engine.hybrid_setup()),
    "/retrieve": lambda engine, given: {"hits": [r.asDict() for r in engine.retrieve(given["questions"], int(given.get("most", 10))).orderBy("query_id", "rank").collect()]},
}


def answer(engine: Engine, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and answer of one request."""
    if method == "GET" and path == "/":
        return 200, {"service": "lodestone", "tables": engine.health()}
    if method != "POST" or path not in ROUTES:
        return 404, {"error": f"no such path: {method} {path}"}
    try:
        given = json.loads(body or b"{}")
        return 200, ROUTES[path](engine, given if isinstance(given, dict) else {})
    except (KeyError, ValueError) as error:
        return 400, {"error": f"{type(error).__name__}: {error}"}
    except Exception as error:  # a step that fails must not end the service
        return 500, {"error": f"{type(error).__name__}: {error}"}


def server(engine: Engine, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that isn't running yet."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = answer(engine, method, self.path, body)
            text = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def do_GET(self) -> None:
            self.reply("GET")

        def do_POST(self) -> None:
            self.reply("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
