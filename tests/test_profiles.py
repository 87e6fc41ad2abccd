"""The questions about profiles on small texts with known answers."""

import pytest

from emberfold.api import Engine
from emberfold.errors import ApiError
from emberfold.operators.paths import FrameWindow
from emberfold.sources.folded import Limits, read_profile

TEXTS = {
    "DIAMOND": "root;A;X 20\nroot;B;X 30\n",
    "SHARED_CALLEE": "root;A;X;leaf1 20\nroot;B;X;leaf2 30\n",
    "RECURSION": "root;foo;foo;bar 10\n",
    "SCOPES": "root;A;B 30\nroot;A;C 20\nroot;A 5\n",
    "FLAT": "A 5\nB 4\nC 1\n",
    "TWO_PATHS": "root;foo;foo;bar 10\nroot;foo;z 5\n",
    "WINDOW": "root;a;foo;foo;b;leaf 10\n",
    "BUDGET": "root;a;b;foo;c;d;e 10\nroot;x;foo;y;z 5\n",
    "BOUNDARY": "foo;middle;leaf 2\nroot;foo;branch 10\nroot;x;foo;branch 20\n",
    "DIFF_BASE": "root;only_base 10\nroot;shared 90\n",
    "DIFF_CAND": "root;candidate_first 20\nroot;shared 80\n",
    "NORM_BASE": "root;hot 50\nroot;cold 50\n",
    "NORM_CAND": "root;hot 100\nroot;cold 100\n",
    "EMPTY": "",
}


@pytest.fixture(scope="session")
def profile(spark, tmp_path_factory):
    folder, made = tmp_path_factory.mktemp("folded"), {}

    def get(name):
        if name not in made:
            path = folder / f"{name}.folded"
            path.write_text(TEXTS[name])
            made[name] = read_profile(spark, str(path), meta={"fingerprint": name})
        return made[name]

    return get


@pytest.fixture(scope="session")
def engine(spark, tmp_path_factory):
    return Engine(spark, tmp_path_factory.mktemp("nowhere"))


def code(f, *a, **kw):
    with pytest.raises(ApiError) as e:
        f(*a, **kw)
    assert e.value.retry_hint
    return e.value.code


def names(node):
    return [c["name"] for c in node["children"]]


def test_summary_and_recursion(engine, profile):
    s = engine.summary(profile("RECURSION"))
    assert (s["data"]["total_weight"], s["data"]["max_depth"], s["data"]["frame_count"]) == (10, 4, 3)
    foo = next(r for r in s["data"]["top_inclusive"] if r["name"] == "foo")
    assert foo["inclusive_weight"] == 10 and foo["frame_id"] == 1
    up = engine.callers({"frame_name": "foo"}, 5, 64, 0.0, profile("RECURSION"))["data"]["root"]
    assert names(up) == ["foo"] and names(up["children"][0]) == ["root"]
    down = engine.callees({"frame_name": "foo"}, 5, 64, 0.0, profile("RECURSION"))["data"]["root"]
    assert names(down) == ["foo"] and names(down["children"][0]) == ["bar"]
    empty = engine.summary(profile("EMPTY"))
    assert (empty["data"]["total_weight"], empty["data"]["max_depth"], empty["data"]["top_self"]) == (0, 0, [])
    assert engine.tree(profile=profile("EMPTY"))["data"]["root"]["total_weight"] == 0


def test_callers_and_callees(engine, profile):
    assert names(engine.callers({"frame_name": "X"}, 5, 64, 0.0, profile("DIAMOND"))["data"]["root"]) == ["B", "A"]
    r = engine.callees({"frame_name": "X"}, 5, 64, 0.0, profile("SHARED_CALLEE"))
    assert r["scope_weight"] == 50 and names(r["data"]["root"]) == ["leaf2", "leaf1"] and r["data"]["root"]["node_id"] is None


def test_top_and_find(engine, profile):
    p = profile("SCOPES")
    a = engine.find_symbols("A", profile=p)["data"]["matches"][0]
    assert (a["self_weight"], a["inclusive_weight"], a["name"]) == (5, 55, "A") and a["context_hint"]["top_callees"][0]["name"] == "B"
    t = engine.top(focus={"frame_name": "A"}, name_regex="B|C", profile=p)
    assert t["scope_weight"] == 55 and [r["name"] for r in t["data"]["rows"]] == ["B", "C"]
    assert engine.top(name_regex="^A$", profile=p)["data"]["rows"][0]["profile_percent"] == 100 * 5 / 55
    none = engine.find_symbols("nothing", profile=p)
    assert none["warnings"] and none["data"]["matches"] == []
    assert engine.find_symbols("", profile=p, limit=1)["truncation_reasons"][0]["available"] == 4


def test_tree_budgets(engine, profile):
    p = profile("FLAT")
    r = engine.tree(0, None, 0, 1, 0.0, p)
    assert r["data"]["root"]["omitted_children"] == 3 and r["truncation_reasons"] == [{"kind": "depth_limit", "max_depth": 0, "omitted_children": 3, "omitted_weight": 10}]
    assert (len(r["data"]["continuations"]), r["data"]["continuations_available"], r["data"]["continuations_omitted"]) == (3, 3, 0)
    assert [x["kind"] for x in engine.tree(0, None, 4, 64, 20.0, p)["truncation_reasons"]] == ["min_scope_percent"]
    r = engine.tree(0, None, 4, 2, 0.0, p)
    assert [x["kind"] for x in r["truncation_reasons"]] == ["node_budget"] and names(r["data"]["root"]) == ["A"]
    node = r["data"]["root"]["children"][0]["node_id"]
    assert engine.tree(node, "FLAT", 4, 2, 0.0, p)["scope_weight"] == 5
    assert code(engine.tree, node, None, profile=p) == "profile_changed"
    assert code(engine.tree, 99, "FLAT", profile=p) == "invalid_node_id"


def test_selectors_budgets_and_patterns(engine, profile):
    p = profile("TWO_PATHS")
    r = engine.paths({"frame_name": "foo"}, 1, profile=p)
    assert r["data"]["paths"][0]["target_positions"] == [1, 2] and r["truncation_reasons"][0] == {"kind": "row_limit", "limit": 1, "returned": 1, "available": 2, "omitted": 1}
    for bad in ("[", "a" * 4097, "(?=a)", r"(a)\1"):
        assert code(engine.top, name_regex=bad, profile=p) == "invalid_regex"
    assert code(engine.paths, {"frame_id": 1, "frame_name": "foo"}, profile=p) == "invalid_frame_selector"
    assert code(engine.paths, {"frame_name": "no"}, profile=p) == "frame_not_found"
    assert code(engine.top, limit=201, profile=p) == "invalid_budget" == code(engine.top, sort="other", profile=p) == code(engine.paths, {"frame_name": "foo"}, max_total_frames=5001, profile=p)
    for w in (FrameWindow("around_target"), FrameWindow("head"), FrameWindow("tail", 4097), FrameWindow("around_target", before=4097)):
        assert code(engine.paths, {"frame_name": "foo"}, frame_window=w, profile=p) == "invalid_budget"
    assert code(engine.load) == "workspace_not_registered"


@pytest.mark.parametrize(
    "window, frames, bounds",
    [(FrameWindow("head", 2), ["root", "a"], (0, 2)), (FrameWindow("tail", 2), ["b", "leaf"], (4, 6)), (FrameWindow("around_target", before=1, after=1), ["a", "foo", "foo", "b"], (1, 5))],
)
def test_windows(engine, profile, window, frames, bounds):
    r = engine.paths({"frame_name": "foo"}, frame_window=window, profile=profile("WINDOW"))
    row = r["data"]["paths"][0]
    assert row["frames"] == frames and (row["frame_start"], row["frame_end"]) == bounds and row["target_positions"] == [2, 3] and row["total_depth"] == 6
    assert [x["kind"] for x in r["truncation_reasons"]] == ["frame_window"]
    assert row["display_target_positions"] == [p - bounds[0] for p in (2, 3) if bounds[0] <= p < bounds[1]]


def test_frame_budget(engine, profile):
    p = profile("BUDGET")
    r = engine.paths({"frame_name": "foo"}, 10, 5, profile=p)
    row = r["data"]["paths"][0]
    assert row["frames"] == ["a", "b", "foo", "c", "d"] and row["display_target_positions"] == [2] and (row["budget_omitted_before"], row["budget_omitted_after"]) == (1, 1)
    assert r["data"]["total_frame_budget"] == {"limit": 5, "available": 12, "returned": 5, "omitted": 7, "selected_paths": 2, "returned_paths": 1, "omitted_paths": 1, "cropped_paths": 1}
    r = engine.paths({"frame_name": "foo"}, 10, 7, profile=p)
    assert (r["data"]["total_frame_budget"]["returned"], r["data"]["total_frame_budget"]["cropped_paths"], r["truncation_reasons"][-1]["kind"]) == (7, 0, "total_frame_budget")
    got = [engine.paths({"frame_name": "foo"}, 10, 3, FrameWindow(m, 7), p)["data"]["paths"][0]["frames"] for m in ("head", "tail")]
    assert got == [["root", "a", "b"], ["c", "d", "e"]]
    b = profile("BOUNDARY")
    rows = engine.paths({"frame_name": "foo"}, frame_window=FrameWindow("around_target", before=5, after=1), profile=b)["data"]["paths"]
    edge = next(x for x in rows if x["target_positions"] == [0])
    assert (edge["frame_start"], edge["frame_end"], edge["omitted_before"], edge["omitted_after"]) == (0, 2, 0, 1)
    assert engine.paths({"frame_name": "foo"}, 2, profile=b)["scope_weight"] == 32


def test_diff(engine, profile):
    a, b = profile("DIFF_BASE"), profile("DIFF_CAND")
    r = engine.diff(a, b)
    assert (r["data"]["rows"][0]["name"], r["data"]["rows"][0]["delta_pp"], r["scope_weight"]) == ("candidate_first", 20.0, {"baseline": 100, "candidate": 100})
    assert engine.diff(a, b, sort="improvement")["data"]["rows"][0]["name"] == "only_base"
    assert engine.diff(a, b, limit=1)["truncation_reasons"][0]["available"] == 4
    hot = next(x for x in engine.diff(profile("NORM_BASE"), profile("NORM_CAND"), sort="absolute")["data"]["rows"] if x["name"] == "hot")
    assert (hot["baseline_weight"], hot["candidate_weight"], hot["delta_pp"]) == (50, 100, 0.0)


@pytest.mark.parametrize(
    "text, expected",
    [
        (b"\r\nroot;frame with spaces 3 \t\r\nroot;frame with spaces 7\n", 10),
        (b"root;A  \t37\n", 37),
        (b"root;A +5", 5),
        (b"  root;A 1\na\rb;c\x0bd 2\n", 3),
        (b"root;   1\n", "invalid_folded_line"),
        (b"root;A\n", "invalid_folded_line"),
        (b"   5\n", "invalid_folded_line"),
        (b"root;;A 1\n", "invalid_folded_line"),
        (b"root;\xff 1\n", "invalid_folded_line"),
        (b"ok 1\nroot;A nope\nroot;;A 1\n", "invalid_weight"),
        (b"root;A 0\n", "invalid_weight"),
        (b"root;A -5\n", "invalid_weight"),
        (b"root;A 1.5\n", "invalid_weight"),
        (b"a;;b 9007199254740993\n", "invalid_folded_line"),
        (b"a 9007199254740993\nb nope\n", "invalid_weight"),
        (b"a 18446744073709551615\n", "weight_overflow"),
        (b"a 18446744073709551615\nb 1\na 1\nc nope\n", "weight_overflow"),
        (b"a 18446744073709551615\nc nope\na 1\n", "invalid_weight"),
        (b"root;A 18446744073709551616\n", "weight_overflow"),
        (b"a 9007199254740991\nb 1\n", "weight_overflow"),
    ],
)
def test_parser(spark, tmp_path, text, expected):
    path = tmp_path / "p.folded"
    path.write_bytes(text)
    if isinstance(expected, int):
        assert read_profile(spark, str(path)).total_weight == expected
    else:
        assert code(read_profile, spark, str(path)) == expected


@pytest.mark.parametrize(
    "limits, text, expected",
    [(Limits(depth=2), "a;b;c 1\n", "stack_too_deep"), (Limits(line_bytes=3), "a 1\n", "invalid_folded_line"), (Limits(line_bytes=3), "a 1\na 1\nab 1", "invalid_folded_line"), (Limits(frames=1), "a 1\nb 1\nc nope\n", "too_many_frames"), (Limits(frames=1), "a 1\nc nope\nb 1\n", "invalid_weight"), (Limits(total_weight=2), "a 3\n", "weight_overflow"), (Limits(file_bytes=3), "a 1\n", "profile_too_large"), (Limits(frames=1), "a;b 1\n", "too_many_frames")],
)
def test_limits(spark, tmp_path, limits, text, expected):
    path = tmp_path / "p.folded"
    path.write_text(text)
    assert code(read_profile, spark, str(path), limits) == expected


def test_stream(spark, tmp_path):
    from emberfold.streaming.folded import arriving_failures, arriving_lines, running_weights

    (tmp_path / "a.folded").write_text("root;A 3\nbad\n")
    (tmp_path / "b.folded").write_text("root;A;root 4\n")
    q = running_weights(arriving_lines(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("running").collect()} == {("root", 4, 7), ("A", 3, 7)}
    q = arriving_failures(spark, str(tmp_path)).writeStream.format("memory").queryName("failures").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["file"].rsplit("/", 1)[1], r["reason"], r["preview"]) for r in spark.table("failures").collect()] == [("a.folded", "invalid_folded_line", "bad")]


def test_a_last_line_without_line_feed(spark, tmp_path):
    """A line's bound counts its line feed, which a last line may lack."""
    path = tmp_path / "p.folded"
    path.write_bytes(b"a 1\na 2")
    assert read_profile(spark, str(path), Limits(line_bytes=4)).total_weight == 3
    path.write_bytes(b"abc 1\na 2")
    with pytest.raises(ApiError) as e:
        read_profile(spark, str(path), Limits(line_bytes=5))
    assert e.value.details["line"] == 1


def test_the_line_that_first_goes_wrong_is_named(spark, tmp_path):
    path = tmp_path / "p.folded"
    path.write_bytes(b"a 18446744073709551615\nb 1\n\na 1\nc nope\n")
    with pytest.raises(ApiError) as e:
        read_profile(spark, str(path))
    assert (e.value.code, e.value.details["line"]) == ("weight_overflow", 4)
