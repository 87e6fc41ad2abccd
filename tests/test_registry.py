import fcntl
import json

import pytest

from emberfold import registry as R
from emberfold.errors import ApiError


def code(f, *a, **kw):
    with pytest.raises(ApiError) as e:
        f(*a, **kw)
    return e.value.code


def put(work, name, text, alias=None, most=10**6):
    path = work / name
    path.write_text(text)
    return R.register(work, path, alias, most, lambda p: None)


def test_register_replace_and_collect(tmp_path):
    one = put(tmp_path, "first.folded", "root;A 3\r\n")
    two = put(tmp_path, "first.folded", "root;A 3\r\n", "other")
    assert one["alias"] == "first" and one["fingerprint"] == two["fingerprint"]
    put(tmp_path, "first.folded", "root;B 4\n")
    put(tmp_path, "x.folded", "root;C 4\n", "other")
    s = R.status(tmp_path)
    assert s["active"] == "other" and [p["alias"] for p in s["profiles"]] == ["first", "other"]
    (tmp_path / R.FOLDER / R.BLOBS / "note.txt").write_text("kept")
    plan, done = R.gc(tmp_path, True), R.gc(tmp_path)
    assert plan["removed"] == done["removed"] == [one["file"]] and done["skipped"] == ["profiles/note.txt"]
    sub = tmp_path / "a" / "b"
    sub.mkdir(parents=True)
    assert R.resolve(sub, None, 10**6)[0] == "other" and R.set_active(sub, "first")["active"] == "first"
    assert code(R.resolve, tmp_path, "absent", 10**6) == "profile_alias_not_found"
    assert code(R.resolve, tmp_path, "../../bad", 10**6) == code(R.set_active, tmp_path, "a/b") == "invalid_profile_alias"


@pytest.mark.parametrize("part", ["", "lock", R.BLOBS, R.MANIFEST])
def test_links_are_refused(tmp_path, part):
    work, outside = tmp_path / "work", tmp_path / "outside"
    work.mkdir()
    outside.mkdir()
    if part:
        (work / R.FOLDER).mkdir()
    target = outside / "file" if part in ("lock", R.MANIFEST) else outside
    (work / R.FOLDER / part).symlink_to(target)
    assert code(put, work, "p.folded", "a 1\n") == "registry_corrupt"
    assert not list(outside.iterdir())


def test_a_path_that_is_no_text(tmp_path):
    import os

    work = tmp_path / os.fsdecode(b"\xff-work")
    work.mkdir()
    put(work, "p.folded", "a 1\n")
    json.dumps(R.status(work), ensure_ascii=False).encode()
    assert "\ufffd-work" in R.text_of(R.resolve(work, None, 10)[2])


def test_refusals(tmp_path):
    assert code(put, tmp_path, "p.folded", "a 1\n", "bad/slash") == "invalid_profile_alias"
    assert code(R.register, tmp_path, tmp_path, None, 10, lambda p: None) == "not_a_regular_file"
    assert code(put, tmp_path, "p.folded", "a 1\n", None, 1) == "profile_too_large"
    assert code(R.status, tmp_path) == "workspace_not_registered"
    put(tmp_path, "p.folded", "a 1\n")
    with open(tmp_path / R.FOLDER / "lock", "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        assert code(R.gc, tmp_path) == "registry_busy"
    assert R.gc(tmp_path)["removed"] == []


@pytest.mark.parametrize("change", [lambda m: m.update(extra=1), lambda m: m.update(schema_version=2), lambda m: m.update(active="no"), lambda m: m["profiles"]["p"].update(file="../x"), lambda m: m["profiles"]["p"].update(fingerprint="0"), lambda m: m["profiles"]["p"].update(byte_len=1)])
def test_corruption(tmp_path, change):
    put(tmp_path, "p.folded", "a 1\n")
    path = tmp_path / R.FOLDER / R.MANIFEST
    m = json.loads(path.read_text())
    change(m)
    path.write_text(json.dumps(m))
    assert code(R.resolve, tmp_path, None, 10**6) == "registry_corrupt"


def test_engine_over_registry(spark, tmp_path):
    from emberfold.api import Engine

    put(tmp_path, "p.folded", "root;A 3\nroot;A;B 2\n")
    e = Engine(spark, tmp_path)
    s = e.summary()
    assert s["data"]["total_weight"] == 5 and s["data"]["registry"]["active"] == "p" and len(s["profile"]["fingerprint"]) == 64
    put(tmp_path, "q.folded", "root;A 8\n")
    assert e.summary()["scope_weight"] == 8 and e.diff("p", "q")["scope_weight"] == {"baseline": 5, "candidate": 8}


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from emberfold.__main__ import main

    monkeypatch.chdir(tmp_path)
    assert main(["list"]) == 1 and "workspace_not_registered" in capsys.readouterr().err
    (tmp_path / "good.folded").write_text("root;A 3\n")
    (tmp_path / "bad.folded").write_text("root;A 3\nroot;;A 1\n")
    assert main(["register", "bad.folded"]) == 1 and '"line": 2' in capsys.readouterr().err
    assert main(["register", "good.folded"]) == main(["register", "good.folded", "--name", "again"]) == 0
    for args in (["--version"], ["serve"]):
        with pytest.raises(SystemExit):
            main(args)
    assert capsys.readouterr().out.splitlines()[-1].startswith("emberfold ")
    assert main(["use", "good"]) == main(["list"]) == main(["gc", "--dry-run"]) == 0
    out = capsys.readouterr().out
    assert "active alias=good" in out and "* good" in out and "dry_run=true" in out
    assert main(["query", "paths", '{"through": {"frame_name": "A"}, "frame_window": {"mode": "head", "lines": 1}}']) == 0
    assert json.loads(capsys.readouterr().out)["data"]["paths"][0]["frames"] == ["root"]
