"""A server of the JSON tools: JSON-RPC 2.0, one message a line, on standard input and output."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from . import __version__, api

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
#: name: (what it does, its arguments, those that must be given, the function of corpus and arguments).
TOOLS = {
    "lint_symbol": ("Violations of one reference page.", {"framework": _TEXT, "symbol": _TEXT}, ["framework"], api.lint_symbol),
    "lint_framework": ("Violations of a framework's pages by page.", {"framework": _TEXT, "max_depth": _NUMBER}, ["framework"], api.lint_framework),
    "page_metadata": ("Title, kind, platforms and place of a reference page.", {"framework": _TEXT, "symbol": _TEXT}, ["framework"], api.page_metadata),
    "search_symbols": ("Reference pages whose title or abstract has a keyword.", {"keyword": _TEXT}, ["keyword"], api.search_symbols),
}


class Server:
    """Answers messages about one corpus; ``corpus`` is a DataFrame (key, json), or a function of a tool call's arguments that gives one."""

    def __init__(self, corpus):
        self._corpus = corpus

    def _called(self, name: str, arguments: dict) -> dict:
        try:
            corpus = self._corpus(arguments) if callable(self._corpus) else self._corpus
            text, failed = TOOLS[name][3](corpus, **arguments), False
        except Exception as error:  # a failed call is an answer, not the end of the server
            text, failed = f"{type(error).__name__}: {error}", True
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def answer(self, message: dict) -> dict | None:
        """The reply to one message; null for a notification."""
        method, given = message.get("method"), message.get("params") or {}
        if "id" not in message:
            return None
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "vellum", "version": __version__}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            tools = [{"name": n, "description": said, "inputSchema": {"type": "object", "properties": fields, "required": must}} for n, (said, fields, must, _) in TOOLS.items()]
            return reply | {"result": {"tools": tools}}
        if method == "tools/call" and given.get("name") in TOOLS:
            return reply | {"result": self._called(given["name"], given.get("arguments") or {})}
        code, said = (-32602, "no such tool") if method == "tools/call" else (-32601, "no such method")
        return reply | {"error": {"code": code, "message": said}}


def serve(spark, corpus_path: str | None = None, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> int:
    """Answer until the input ends. Without a folder of page JSON each call fetches the pages of its framework."""
    from .sources import files, http_pages

    if corpus_path:
        corpus = files.read_page_corpus(spark, corpus_path)
    else:
        corpus = lambda given: http_pages.fetch_corpus(spark, given.get("framework", ""), given.get("symbol", ""), given.get("max_depth", 2))
    server = Server(corpus)
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            reply = server.answer(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        if reply is not None:
            print(json.dumps(reply), file=sink, flush=True)
    return 0
