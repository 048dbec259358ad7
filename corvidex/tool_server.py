"""The engine as tools of a JSON-RPC server over standard input and output, one message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from . import api
from .errors import EngineError

_TEXT, _COUNT, _NUMBER, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}


def _object(required: tuple[str, ...], **properties) -> dict:
    return {"type": "object", "properties": properties, "required": list(required)}


def tools(engine: Callable[[], api.Engine]) -> dict[str, tuple[str, dict, Callable]]:
    """Name to (description, schema of the arguments, function); the engine is made when a tool first needs it."""
    return {
        "search": ("Hybrid search by words and vectors; filters may stand in the query.", _object(("query",), query=_TEXT, k=_COUNT, threshold=_NUMBER, expand=_FLAG), lambda **a: engine().search(**a)),
        "ask": ("An answer from the indexed documents, with its sources.", _object(("question",), question=_TEXT, k=_COUNT, threshold=_NUMBER, expand=_FLAG), lambda **a: engine().ask(**a)),
        "fts": ("Keyword search.", _object(("query",), query=_TEXT, k=_COUNT), lambda **a: engine().fts(**a)),
        "similar": ("Documents like one that is indexed.", _object(("name",), name=_TEXT, k=_COUNT), lambda **a: engine().similar(**a)),
        "status": ("Figures of the index.", _object(()), lambda: {k: v for k, v in engine().stats().items() if k != "documents"}),
        "list": ("The indexed documents.", _object(()), lambda: engine().list()),
        "feedback": ("Leave a note on the engine.", _object(("message",), message=_TEXT, tool=_TEXT, severity=_TEXT, context=_TEXT, agent_id=_TEXT, error_trace=_TEXT), lambda **a: api.feedback(**a)),
    }


def handle(request: dict, known: dict[str, tuple[str, dict, Callable]]) -> dict | None:
    """The answer to one request; None for a notification. What the engine refuses comes back as {"error": ...}."""
    method, number = request.get("method"), request.get("id")
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        asked = request.get("params", {}).get("protocolVersion", "2024-11-05")
        return reply | {"result": {"protocolVersion": asked, "capabilities": {"tools": {}}, "serverInfo": {"name": "corvidex", "version": api.engine_version()}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in known.items()]}}
    if method == "ping":
        return reply | {"result": {}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    params = request.get("params", {})
    if params.get("name") not in known:
        return reply | {"error": {"code": -32602, "message": f"no tool {params.get('name')}"}}
    try:
        value = known[params["name"]][2](**params.get("arguments", {}))
    except (EngineError, TypeError) as e:
        value = {"error": str(e)}
    return reply | {"result": {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False, default=str)}], "isError": "error" in value}}


def serve(engine: Callable[[], api.Engine], source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    known = tools(engine)
    for line in source:
        if line.strip() and (reply := handle(json.loads(line), known)) is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
