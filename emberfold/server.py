"""The questions as tools over standard input and output: one JSON-RPC message a line.

``tools/list`` gives the tools with the schemas of their arguments, ``tools/call`` a result as structured content with a short text. Arguments of a
wrong shape are protocol errors; values out of range and everything else that a question refuses are results marked as errors.
"""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from .api import SCHEMA_VERSION, Engine
from .errors import ApiError
from .operators.paths import FrameWindow

PROTOCOL = "2024-11-05"
MOST_TEXT = 2048

_S, _I, _N = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "number"}
_PROFILE = {"profile": _S}
_FRAME = {"oneOf": [{"type": "object", "properties": {k: v}, "required": [k], "additionalProperties": False} for k, v in (("frame_id", _I), ("frame_name", _S))]}
_SIDE = {"type": "object", "properties": {"mode": {"enum": ["head", "tail"]}, "lines": _I}, "required": ["mode", "lines"], "additionalProperties": False}
_AROUND = {
    "type": "object", "properties": {"mode": {"enum": ["around_target"]}, "before": _I, "after": _I}, "required": ["mode", "before", "after"],
    "additionalProperties": False
}
_TREE = {"max_depth": _I, "max_nodes": _I, "min_scope_percent": _N}

#: Name without prefix, description, arguments, those required.
TOOLS: dict[str, tuple[str, dict[str, Any], list[str]]] = {
    "summary": ("Totals and heaviest frames of a profile, and the registered aliases.", _PROFILE, []),
    "find_symbols": ("Frames by part of their name or a pattern, with observed callers and callees.", _PROFILE | {"query": _S, "mode": _S, "limit": _I}, ["query"]),
    "top": (
        "Frames ranked by self or inclusive weight, of all stacks or of those with one frame.",
        _PROFILE | {"sort": _S, "limit": _I, "focus": _FRAME, "name_regex": _S}, []
    ),
    "tree": ("A page of the calling-context tree, with where to continue.", _PROFILE | {"root_node_id": _I, "profile_fingerprint": _S} | _TREE, []),
    "callers": ("The merged ways to a frame.", _PROFILE | {"frame": _FRAME} | _TREE, ["frame"]),
    "callees": ("The merged ways from a frame.", _PROFILE | {"frame": _FRAME} | _TREE, ["frame"]),
    "paths": (
        "The heaviest complete stacks through a frame.",
        _PROFILE | {"through": _FRAME, "limit": _I, "max_total_frames": _I, "frame_window": {"oneOf": [_SIDE, _AROUND]}}, ["through"]
    ),
    "diff": (
        "Frames whose share differs between two profiles.",
        {"baseline": _S, "candidate": _S, "metric": _S, "sort": _S, "limit": _I, "name_regex": _S}, ["baseline", "candidate"]
    ),
}


def schema_of(tool: str) -> dict:
    _, properties, required = TOOLS[tool]
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


_ANY, _LIST, _NULLABLE = {"type": "object"}, lambda x: {"type": "array", "items": x}, lambda kind: {"type": [kind, "null"]}


def _object(**properties: Any) -> dict:
    return {"type": "object", "properties": properties, "required": sorted(properties)}


_ROW = _object(frame_id=_I, name=_S, self_weight=_I, inclusive_weight=_I, stack_count=_I, profile_percent=_N, scope_percent=_N)
_NODE = _object(
    node_id=_NULLABLE("integer"), frame_id=_NULLABLE("integer"), name=_NULLABLE("string"), self_weight=_I, total_weight=_I, profile_percent=_N, scope_percent=_N, omitted_children=_I, omitted_weight=_I, children=_LIST({"$ref": "#/$defs/node"})
)
_NEXT = _object(
    node_id=_I, frame_id=_I, name=_S, reason={"enum": ["depth_limit", "min_scope_percent", "node_budget"]}, profile_fingerprint=_NULLABLE("string"),
    total_weight=_I, profile_percent=_N, scope_percent=_N
)
_PLACES = {
    k: _I for k in (
        "total_depth", "requested_frame_start", "requested_frame_end", "frame_start", "frame_end", "omitted_before", "omitted_after",
        "budget_omitted_before", "budget_omitted_after"
    )
}
_PATH = _object(frames=_LIST(_S), weight=_I, profile_percent=_N, scope_percent=_N, target_positions=_LIST(_I), display_target_positions=_LIST(_I), **_PLACES)
_BUDGET = _object(**{k: _I for k in ("limit", "available", "returned", "omitted", "selected_paths", "returned_paths", "omitted_paths", "cropped_paths")})
_DELTA = _object(name=_S, baseline_weight=_I, candidate_weight=_I, baseline_percent=_N, candidate_percent=_N, delta_pp=_N)
_DIRECTED = _object(frame=_ROW, root={"$ref": "#/$defs/node"})
#: The schema of each tool's ``data``; the two that aren't here give any object.
_DATA = {
    "top": _object(sort=_S, focus=_NULLABLE("integer"), rows=_LIST(_ROW)),
    "tree": _object(
        root={"$ref": "#/$defs/node"}, continuations=_LIST(_NEXT), continuations_truncated={"type": "boolean"}, continuation_limit=_I,
        continuations_available=_I, continuations_omitted=_I
    ),
    "callers": _DIRECTED,
    "callees": _DIRECTED,
    "paths": _object(through=_I, paths=_LIST(_PATH), total_frame_budget=_BUDGET),
    "diff": _object(metric=_S, sort=_S, rows=_LIST(_DELTA)),
}


def output_schema_of(tool: str) -> dict:
    """A result's envelope, or an error's four fields."""
    meta = {"type": "object", "properties": {"canonical_path": _S, "fingerprint": _S, "byte_len": _I, "modified_unix_ms": _NULLABLE("integer"), "alias": _S}}
    profiles, scope = (["baseline", "candidate"], _object(baseline=_I, candidate=_I)) if tool == "diff" else (["profile"], _I)
    own = {
        "schema_version": {"type": "string", "const": SCHEMA_VERSION}, **{p: meta for p in profiles}, "scope_weight": scope,
        "truncated": {"type": "boolean"}, "truncation_reasons": _LIST(_object(kind=_S)), "warnings": _LIST(_S)
    }
    error = {"code": _S, "message": _S, "details": {}, "retry_hint": _S}
    out = {
        "type": "object", "properties": {**own, "data": {"$ref": "#/$defs/data"} if tool in _DATA else _ANY, **error},
        "anyOf": [{"required": [*own, "data"]}, {"required": list(error)}]
    }
    return out | {"$defs": {"data": _DATA[tool], "node": _NODE}} if tool in _DATA else out


def fits(value: Any, schema: dict) -> bool:
    """Whether a value has the shape that the schema states; only what the schemas above use."""
    if "oneOf" in schema:
        return sum(fits(value, s) for s in schema["oneOf"]) == 1
    if "enum" in schema:
        return value in schema["enum"]
    kind = schema["type"]
    if kind == "object":
        return isinstance(value, dict) and set(schema["required"]) <= set(value) <= set(schema["properties"]) and all(
            fits(v, schema["properties"][k]) for k, v in value.items()
        )
    if kind == "string":
        return isinstance(value, str)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return number and (kind == "number" or (isinstance(value, int) and value >= schema["minimum"]))


def short(text: str) -> str:
    """At most ``MOST_TEXT`` bytes of whole characters, control characters replaced."""
    safe = "".join(c if c.isprintable() or c == " " else "�" for c in text)
    return safe.encode("utf-8", "replace")[:MOST_TEXT].decode("utf-8", "ignore")


def text_of(result: dict) -> str:
    data = result["data"]
    parts = [f"scope_weight={json.dumps(result['scope_weight'])}", f"truncated={','.join(r['kind'] for r in result['truncation_reasons']) or 'no'}"]
    for key in ("matches", "rows", "paths", "continuations", "top_self"):
        if key in data:
            named = [str(r["name"]) for r in data[key] if "name" in r][:5]
            parts.append(f"{key}={len(data[key])} {named}" if named else f"{key}={len(data[key])}")
    return short("; ".join(parts))


class Server:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def call(self, tool: str, arguments: dict) -> dict:
        given = {k: v for k, v in arguments.items()}
        if "frame_window" in given:
            given["frame_window"] = FrameWindow(**given["frame_window"])
        try:
            result = getattr(self.engine, tool)(**given)
        except ApiError as e:
            return {"content": [{"type": "text", "text": short(f"{e.code}: {e.message}")}], "structuredContent": e.as_dict(), "isError": True}
        except Exception as e:
            print(e, file=sys.stderr)
            error = ApiError("internal_error", "The question couldn't be answered", {}, "See the server's error output and call again.")
            return {"content": [{"type": "text", "text": error.code}], "structuredContent": error.as_dict(), "isError": True}
        return {"content": [{"type": "text", "text": text_of(result)}], "structuredContent": result, "isError": False}

    def answer(self, message: dict) -> dict | None:
        """The reply to one message; none to a notification."""
        if not isinstance(message, dict) or "id" not in message:
            return None
        reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "emberfold", "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {
                "result": {
                    "tools": [
                        {"name": f"profile_{n}", "description": d, "inputSchema": schema_of(n), "outputSchema": output_schema_of(n)} for n,
                        (d, _, _) in TOOLS.items()
                    ]
                }
            }
        if method != "tools/call":
            return reply | {"error": {"code": -32601, "message": "no such method"}}
        name, arguments = str(params.get("name", "")).removeprefix("profile_"), params.get("arguments") or {}
        if name not in TOOLS or not fits(arguments, schema_of(name)):
            return reply | {"error": {"code": -32602, "message": "no such tool, or its arguments have another shape"}}
        return reply | {"result": self.call(name, arguments)}

    def serve(self, source: TextIO, target: TextIO) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                # what isn't text of Unicode, such as half of a surrogate pair, must not end the server
                target.write(json.dumps(reply, ensure_ascii=False).encode("utf-8", "replace").decode() + "\n")
                target.flush()
