"""The operations of an index as JSON over HTTP, for tools on the same machine.

GET /api/state tells what the index holds, GET /api/tools which operations there are and what they
take, POST /api/tools/<name> runs one with a JSON object of arguments. The server listens on the
loopback address only, answers only requests that name that host, and needs the header
``X-Quillspark`` on everything but GET, which a page of another site cannot send.
"""

from __future__ import annotations

import inspect
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from quillspark.api import CorpusIndex

#: The operations that may be called, and how many rows of an answer are sent.
TOOLS = ("search", "find_files", "read_document", "read_fresh", "find_in_document", "list_folder", "live_folder", "list_projects", "project_cards", "catalog", "catalog_coverage", "register_summary", "world_map", "status", "problems")
MOST_ROWS = 1000
HOSTS = ("127.0.0.1", "localhost", "[::1]")
HEADER = "X-Quillspark"


def describe_tools() -> dict[str, dict]:
    """Name, purpose and parameters of each operation, with their defaults."""
    out = {}
    for name in TOOLS:
        method = getattr(CorpusIndex, name)
        parameters = [p for p in inspect.signature(method).parameters.values() if p.name != "self" and p.kind is not p.VAR_KEYWORD]
        out[name] = {"about": inspect.getdoc(method) or "", "parameters": {p.name: {"required": p.default is p.empty, **({} if p.default is p.empty else {"default": p.default})} for p in parameters}}
    return out


def answer(index: CorpusIndex, name: str, arguments: dict) -> dict:
    """The rows or lines of one operation; ValueError for an unknown one or wrong arguments."""
    if name not in TOOLS:
        raise ValueError(f"no operation {name}")
    method = getattr(index, name)
    try:
        inspect.signature(method).bind(**arguments)
    except TypeError as e:
        raise ValueError(str(e)) from None
    out = method(**arguments)
    if isinstance(out, DataFrame):
        rows = [r.asDict(recursive=True) for r in out.limit(MOST_ROWS + 1).collect()]
        return {"rows": rows[:MOST_ROWS], "more": len(rows) > MOST_ROWS}
    return {"lines": out}


def make_handler(index: CorpusIndex) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, code: int, body: dict) -> None:
            data = json.dumps(body, default=str, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _allowed(self) -> bool:
            host = (self.headers.get("Host") or "").rsplit(":", 1)[0] if not (self.headers.get("Host") or "").endswith("]") else self.headers["Host"]
            if host not in HOSTS:
                self._send(403, {"error": "this host is not served"})
            elif self.command != "GET" and self.headers.get(HEADER) is None:
                self._send(403, {"error": f"the header {HEADER} is missing"})
            else:
                return True
            return False

        def do_GET(self) -> None:
            if not self._allowed():
                return
            if self.path == "/api/tools":
                self._send(200, describe_tools())
            elif self.path == "/api/state":
                number, state = index.tables.states.newest()
                self._send(200, {"state": number, "root": index.root, "profile": index.profile, "notes": state.get("notes", {}), "tables": {k: len(v) for k, v in state.get("tables", {}).items()}})
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            if not self._allowed():
                return
            name = self.path.removeprefix("/api/tools/")
            try:
                size = int(self.headers.get("Content-Length") or 0)
                arguments = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(arguments, dict):
                    raise ValueError("arguments must be a JSON object")
                self._send(200, answer(index, name, arguments))
            except ValueError as e:
                self._send(400, {"error": str(e)})
            except PySparkException as e:
                self._send(500, {"error": str(e).splitlines()[0]})

    return Handler


def make_server(index: CorpusIndex, port: int = 0) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), make_handler(index))


def serve(index: CorpusIndex, port: int) -> None:
    """Answers until it is interrupted."""
    with make_server(index, port) as s:
        print(f"http://127.0.0.1:{s.server_address[1]}/api/tools")
        try:
            s.serve_forever()
        except KeyboardInterrupt:
            pass
