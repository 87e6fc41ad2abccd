import io
import json

import pytest

from emberfold import registry as R
from emberfold.api import Engine
from emberfold.server import MOST_TEXT, Server, output_schema_of, short


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    work = tmp_path_factory.mktemp("served")
    (work / "p.folded").write_text("root;A 3\nroot;A;B 2\n")
    R.register(work, work / "p.folded", None, 10**6, lambda p: None)
    server = Server(Engine(spark, work))

    def call(tool, **arguments):
        out = io.StringIO()
        server.serve(io.StringIO(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}}) + "\n"), out)
        return json.loads(out.getvalue())

    call.server = server
    return call


def test_protocol(ask):
    out = io.StringIO()
    ask.server.serve(io.StringIO('{"id": 1, "method": "initialize"}\n\nnot json\n{"method": "notifications/initialized"}\n{"id": 2, "method": "tools/list"}\n{"id": 3, "method": "other"}\n'), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("id") for r in replies] == [1, None, 2, 3] and replies[3]["error"]["code"] == -32601
    assert [t["name"] for t in replies[2]["result"]["tools"]] == [f"profile_{x}" for x in ("summary", "find_symbols", "top", "tree", "callers", "callees", "paths", "diff")]
    for t in replies[2]["result"]["tools"]:
        schema = t["outputSchema"]
        assert schema["type"] == "object" and schema["properties"]["schema_version"] == {"type": "string", "const": "2"}
        assert "truncation_reasons" in schema["anyOf"][0]["required"] and schema["anyOf"][1]["required"] == ["code", "message", "details", "retry_hint"]
        assert ("$ref" in schema["properties"]["data"]) == (t["name"] not in ("profile_summary", "profile_find_symbols"))


def conforms(value, schema, whole):
    """Only what the schemas use."""
    if "$ref" in schema:
        return conforms(value, whole["$defs"][schema["$ref"].rsplit("/", 1)[1]], whole)
    if "enum" in schema:
        return value in schema["enum"]
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
    if "type" in schema and not any(isinstance(value, kinds[k]) for k in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])):
        return False
    if isinstance(value, dict):
        return set(schema.get("required", ())) <= set(value) and all(conforms(v, schema["properties"][k], whole) for k, v in value.items() if k in schema.get("properties", {}))
    return not isinstance(value, list) or all(conforms(v, schema["items"], whole) for v in value)


def test_results_have_the_shape_they_state(ask):
    frame = {"frame": {"frame_name": "A"}}
    for tool, arguments in (("summary", {}), ("find_symbols", {"query": "A"}), ("top", {}), ("tree", {"max_depth": 1}), ("callers", frame), ("callees", frame), ("paths", {"through": {"frame_name": "A"}}), ("diff", {"baseline": "p", "candidate": "p"})):
        schema, r = output_schema_of(tool), ask(f"profile_{tool}", **arguments)["result"]["structuredContent"]
        assert set(schema["anyOf"][0]["required"]) <= set(r) and conforms(r, schema, schema), tool


def test_shapes_are_protocol_errors_and_values_are_results(ask):
    for tool, arguments in (("profile_top", {"extra": 1}), ("profile_top", {"limit": "5"}), ("profile_paths", {"through": {"frame_id": 1, "frame_name": "A"}}), ("profile_callers", {}), ("profile_other", {}), ("profile_top", {"limit": True})):
        assert ask(tool, **arguments)["error"]["code"] == -32602
    bad = ask("profile_top", limit=500)["result"]
    assert bad["isError"] and bad["structuredContent"]["code"] == "invalid_budget"
    assert ask("profile_summary", profile="absent")["result"]["structuredContent"]["code"] == "profile_alias_not_found"


def test_results(ask):
    r = ask("profile_paths", through={"frame_name": "A"}, limit=2, frame_window={"mode": "around_target", "before": 0, "after": 1})["result"]
    row = r["structuredContent"]["data"]["paths"][0]
    assert (row["target_positions"], row["display_target_positions"], row["frame_start"], row["frame_end"], row["omitted_before"]) == ([1], [0], 1, 2, 1)
    assert not r["isError"] and len(r["content"][0]["text"].encode()) <= MOST_TEXT
    assert ask("profile_diff", baseline="p", candidate="p")["result"]["structuredContent"]["data"]["rows"][0]["delta_pp"] == 0.0
    assert ask("profile_tree")["result"]["structuredContent"]["data"]["root"]["total_weight"] == 5


def test_short():
    assert short("a\x00b\n") == "a�b�" and len(short("é" * 3000).encode()) == MOST_TEXT
