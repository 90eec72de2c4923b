"""The query tools for clients: one request and one answer as JSON, over lines or HTTP."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, Any

from pyspark.sql import DataFrame

from .tools import TOOLS

#: What each tool takes: tables by name, then arguments by name.
NEEDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "list_features": (("features",), ()),
    "find_feature": (("features",), ("query",)),
    "get_feature_files": (("features", "flows"), ("name",)),
    "get_flow_files": (("flows",), ("feature", "flow")),
    "get_repo_summary": (("features", "flows"), ()),
    "get_hotspots": (("features", "flows"), ("limit",)),
    "get_feature_owners": (("features", "flows"), ("name",)),
    "analyze_change_impact": (("features", "feature_paths"), ("changed",)),
    "get_regression_risk": (("features", "feature_paths"), ("changed",)),
    "find_symbols_in_flow": (("symbols", "flows"), ("feature", "flow")),
    "find_symbols_for_feature": (("symbols",), ("feature",)),
    "get_feature_errors": (("features", "errors"), ("name",)),
    "get_feature_pageviews": (("features", "pageviews"), ("name",)),
}


#: Rows of an answer at most; one that has more says so.
MOST_ROWS = 1000


def answer(tables: dict[str, DataFrame], request: dict[str, Any], most: int = MOST_ROWS) -> dict[str, Any]:
    """The first ``most`` rows of one tool, and whether there are more, or an error; an argument that a tool doesn't take is an error too. ``changed`` is a list of paths."""
    name, given = request.get("tool"), dict(request.get("args") or {})
    if name == "tools":
        return {"tools": sorted(TOOLS)}
    if name not in NEEDS:
        return {"error": f"no tool {name}"}
    needed, taken = NEEDS[name]
    missing = [t for t in needed if t not in tables]
    unknown = [a for a in given if a not in taken]
    if missing or unknown:
        return {"error": f"missing tables {missing}" if missing else f"unknown arguments {unknown}"}
    if "changed" in given:
        spark = next(iter(tables.values())).sparkSession
        given["changed"] = spark.createDataFrame([(p,) for p in given["changed"]], "path string")
    try:
        rows = TOOLS[name](*(tables[t] for t in needed), **given)
    except TypeError as e:
        return {"error": str(e)}
    found = rows.toJSON().take(most + 1)
    return {"rows": [json.loads(x) for x in found[:most]]} | ({"more": True} if len(found) > most else {})


def serve_lines(tables: dict[str, DataFrame], source: IO[str], sink: IO[str]) -> int:
    """Answers each line of source by a line of sink; how many there were."""
    n = 0
    for line in source:
        if line.strip():
            try:
                out = answer(tables, json.loads(line))
            except ValueError:
                out = {"error": "a request is a JSON object"}
            sink.write(json.dumps(out) + "\n")
            n += 1
    return n


def http_server(tables: dict[str, DataFrame], port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that answers POSTed requests; the caller starts and stops it."""
    reply: Callable[[dict[str, Any]], dict[str, Any]] = lambda request: answer(tables, request)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                out, code = reply(request), 200
            except ValueError:
                out, code = {"error": "a request is a JSON object"}, 400
            body = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
