"""A tool server: line-delimited JSON-RPC 2.0 over text streams."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import IO

from pyspark.sql import functions as F

from quarry.plans.search import as_dict, search
from quarry.schemas import SearchFilter, SearchOptions
from quarry.sources.files import Embedder
from quarry.sources.store import Store

_TEXT = {"type": "string"}
TOOLS = [
    {"name": "search_code", "description": "Ranked search over the indexed code", "inputSchema": {"type": "object", "properties": {"query": _TEXT, "namespace": _TEXT, "class": _TEXT, "filePattern": _TEXT, "limit": {"type": "integer"}}, "required": ["query"]}},
    {"name": "get_chunk_by_id", "description": "One chunk by its id", "inputSchema": {"type": "object", "properties": {"id": _TEXT}, "required": ["id"]}},
]
CHUNK = ["Id", "FilePath", "NamespaceName", "ClassName", "MemberName", "MemberType", "Content", "Signature", "Documentation", "StartLine", "EndLine", "IsController", "HttpMethods", "RouteTemplate"]


class Server:
    def __init__(self, store: Store, embedder: Embedder, options: SearchOptions = SearchOptions()):
        self.store, self.embedder, self.options = store, embedder, options

    def _call(self, name: str, a: dict) -> object:
        if name == "search_code":
            if not str(a.get("query") or "").strip():
                raise ValueError("query is required")
            f = SearchFilter(a.get("namespace"), a.get("class"), file_pattern=a.get("filePattern"))
            limit = a.get("limit")
            options = replace(self.options, display_count=limit, top_k=max(limit, self.options.top_k)) if isinstance(limit, int) and limit > 0 else self.options
            return as_dict(search(self.store, a["query"], self.embedder, options, f))
        if not a.get("id"):
            raise ValueError("id is required")
        row = self.store.read("chunks").where(F.col("Id") == a["id"]).select(*CHUNK).limit(1).collect()
        return {c[0].lower() + c[1:]: row[0][c] for c in CHUNK} if row else None

    def handle(self, line: str) -> str | None:
        """The answer to one line; None where there is none to give."""
        def answer(key, **body) -> str:
            return json.dumps({"jsonrpc": "2.0", "id": key, **body}, ensure_ascii=False)

        def error(key, code: int, message: str) -> str:
            return answer(key, error={"code": code, "message": message})

        try:
            request = json.loads(line)
        except ValueError:
            return error(None, -32700, "Parse error")
        if not isinstance(request, dict) or "id" not in request:
            return None
        key, method, params = request["id"], request.get("method"), request.get("params") or {}
        try:
            if method == "initialize":
                return answer(key, result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": "0.1.0"}})
            if method == "ping":
                return answer(key, result={})
            if method == "tools/list":
                return answer(key, result={"tools": TOOLS})
            if method != "tools/call":
                return error(key, -32601, f"Method not found: {method}")
            name = params.get("name")
            if not name:
                return error(key, -32602, "Invalid params: name is required")
            if name not in {t["name"] for t in TOOLS}:
                return error(key, -32601, f"Tool not found: {name}")
            try:
                body, bad = json.dumps(self._call(name, params.get("arguments") or {}), ensure_ascii=False), False
            except Exception as e:  # a tool's failure is part of its result
                body, bad = str(e), True
            return answer(key, result={"content": [{"type": "text", "text": body}], "isError": bad})
        except Exception as e:
            return error(key, -32603, f"Internal error: {e}")

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        for line in lines:
            if line.strip() and (reply := self.handle(line)) is not None:
                out.write(reply + "\n")
                out.flush()
