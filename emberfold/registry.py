"""The catalog of a workspace: aliases of stored profiles, whose file names are the hashes of their bytes. No Spark is needed here."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import re
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from .errors import ApiError

FOLDER, MANIFEST, BLOBS = ".emberfold", "manifest.json", "profiles"
#: Fixed value: the grammar of an alias.
ALIAS = r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}"
_ALIAS = re.compile(ALIAS)
_BLOB = re.compile(r"[0-9a-f]{64}\.folded")
_ENTRY = {"fingerprint": str, "file": str, "source_name": str, "byte_len": int, "registered_unix_ms": int}


def _corrupt(message: str, **details: Any) -> ApiError:
    return ApiError("registry_corrupt", message, details, "Register the profiles again.")


def fingerprint(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def valid_alias(alias: str) -> bool:
    return _ALIAS.fullmatch(alias) is not None


def default_alias(source: Path) -> str:
    return source.stem if valid_alias(source.stem) else "default"


def _real(path: Path, right: Callable[[], bool]) -> None:
    """``path`` must not exist, or be of the right kind and no link."""
    if path.is_symlink() or (path.exists() and not right()):
        raise _corrupt("Part of the registry is a link or of another kind", path=text_of(path))


def text_of(path: Path) -> str:
    """A path as text that JSON can hold, also where its bytes aren't UTF-8."""
    return os.fsencode(path).decode("utf-8", "replace")


def discover(start: Path) -> Path | None:
    """The registry of the nearest folder upwards that has one."""
    for folder in (start.resolve(), *start.resolve().parents):
        state = folder / FOLDER
        _real(state, state.is_dir)
        _real(state / MANIFEST, (state / MANIFEST).is_file)
        if (state / MANIFEST).exists():
            return state
    return None


def _required(start: Path) -> Path:
    if (state := discover(start)) is None:
        raise ApiError("workspace_not_registered", "There is no registry in this folder or above it", {"cwd": text_of(start)}, "Register a profile first.")
    return state


def _load(state: Path) -> dict:
    try:
        m = json.loads((state / MANIFEST).read_bytes())
    except (OSError, ValueError) as e:
        raise _corrupt("The manifest can't be read", error=str(e)) from e
    entries = m.get("profiles") if isinstance(m, dict) else None
    if not isinstance(entries, dict) or set(m) != {"schema_version", "active", "profiles"} or type(m["schema_version"]) is not int or m["schema_version"] != 1 or m["active"] not in entries:
        raise _corrupt("The manifest isn't one of version 1 with an active profile")
    for alias, e in entries.items():
        fine = isinstance(e, dict) and set(e) == set(_ENTRY) and all(type(e[k]) is kind for k, kind in _ENTRY.items())
        if not (
            fine and valid_alias(alias) and _BLOB.fullmatch(e["fingerprint"] + ".folded") and e["file"] == f"{BLOBS}/{e['fingerprint']}.folded" and Path(e["source_name"]).name == e["source_name"] not in ("", ".", "..")
        ):
            raise _corrupt("The manifest has an invalid entry", alias=alias)
    return m


def _write(path: Path, data: bytes) -> None:
    """Whole or not at all."""
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


@contextlib.contextmanager
def _locked(state: Path) -> Iterator[None]:
    path = state / "lock"
    _real(path, path.is_file)
    try:
        handle = os.open(path, os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o644)
    except OSError as e:
        raise _corrupt("The lock can't be opened", path=text_of(path)) from e
    with os.fdopen(handle, "r+") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise ApiError("registry_busy", "Another process is changing the registry", {"path": text_of(state)}, "Try again soon.") from e
        opened, there = os.fstat(f.fileno()), os.lstat(path)
        if (opened.st_dev, opened.st_ino) != (there.st_dev, there.st_ino):
            raise _corrupt("The lock was replaced while it was taken", path=text_of(path))
        yield


def _checked(alias: str) -> None:
    if not valid_alias(alias):
        raise ApiError("invalid_profile_alias", f"Not an alias: {alias}", {"alias": alias}, "Use letters, digits, dots, underscores and hyphens, 64 at most.")


def register(workspace: Path, source: Path, alias: str | None, most_bytes: int, check: Callable[[Path], None]) -> dict:
    """Stores the bytes of ``source`` under their hash and makes ``alias`` name them and active. ``check`` raises if the profile is invalid; nothing
    is written then.
    """
    alias = default_alias(source) if alias is None else alias
    _checked(alias)
    if not source.exists():
        raise ApiError("profile_not_found", f"No profile at {text_of(source)}", {"profile": text_of(source)}, "Give the path of an existing file.")
    if not source.is_file():
        raise ApiError("not_a_regular_file", "A profile must be a regular file", {"profile": text_of(source)}, "Give the path of a file.")
    if source.stat().st_size > most_bytes:
        raise ApiError(
            "profile_too_large", "The profile is larger than the limit", {"byte_len": source.stat().st_size, "limit": most_bytes},
            "Raise the limit or make a smaller profile."
        )
    check(source)
    state = workspace.resolve() / FOLDER
    for folder in (state, state / BLOBS):
        _real(folder, folder.is_dir)
        folder.mkdir(parents=True, exist_ok=True)
    data = source.read_bytes()
    own = hashlib.sha256(data).hexdigest()
    with _locked(state):
        _real(state / MANIFEST, (state / MANIFEST).is_file)
        m = _load(state) if (state / MANIFEST).exists() else {"schema_version": 1, "active": alias, "profiles": {}}
        blob, new = state / BLOBS / f"{own}.folded", False
        if not (blob.is_file() and not blob.is_symlink() and fingerprint(blob) == own):
            _write(blob, data)
            new = True
        m["profiles"][alias] = {
            "fingerprint": own, "file": f"{BLOBS}/{own}.folded", "source_name": text_of(Path(source.name)), "byte_len": len(data),
            "registered_unix_ms": int(time.time() * 1000)
        }
        m["active"] = alias
        try:
            _write(state / MANIFEST, json.dumps(m, indent=1, sort_keys=True).encode())
        except BaseException:
            if new:
                blob.unlink(missing_ok=True)
            raise
    return {"alias": alias, **m["profiles"][alias]}


def resolve(workspace: Path, alias: str | None, most_bytes: int) -> tuple[str, dict, Path]:
    state = _required(workspace)
    m = _load(state)
    alias = m["active"] if alias is None else alias
    _checked(alias)
    if alias not in m["profiles"]:
        raise ApiError("profile_alias_not_found", f"No profile is registered as {alias}", {"alias": alias}, "List the aliases.")
    entry = m["profiles"][alias]
    _real(state / BLOBS, (state / BLOBS).is_dir)
    path = state / entry["file"]
    if path.is_symlink() or not path.is_file() or path.stat().st_size != entry["byte_len"]:
        raise _corrupt("A stored profile is absent or has another length", alias=alias)
    if entry["byte_len"] > most_bytes:
        raise ApiError("profile_too_large", "The profile is larger than the limit", {"byte_len": entry["byte_len"], "limit": most_bytes}, "Raise the limit.")
    return alias, entry, path


def status(workspace: Path) -> dict:
    state = _required(workspace)
    m = _load(state)
    return {"registry_root": text_of(state), "active": m["active"], "profiles": [{"alias": a, **m["profiles"][a]} for a in sorted(m["profiles"])]}


def set_active(workspace: Path, alias: str) -> dict:
    state = _required(workspace)
    _checked(alias)
    with _locked(state):
        m = _load(state)
        if alias not in m["profiles"]:
            raise ApiError("profile_alias_not_found", f"No profile is registered as {alias}", {"alias": alias}, "List the aliases.")
        m["active"] = alias
        _write(state / MANIFEST, json.dumps(m, indent=1, sort_keys=True).encode())
    return status(workspace)


def gc(workspace: Path, dry_run: bool = False) -> dict:
    """Removes stored profiles that no alias names; what isn't a stored profile is only reported."""
    state = _required(workspace)
    _real(state / BLOBS, (state / BLOBS).is_dir)
    with _locked(state):
        kept = {e["file"] for e in _load(state)["profiles"].values()}
        removed, skipped = [], []
        for path in sorted((state / BLOBS).iterdir()):
            name = f"{BLOBS}/{path.name}"
            if path.is_symlink() or not path.is_file() or not _BLOB.fullmatch(path.name):
                skipped.append(name)
            elif name not in kept:
                removed.append(name)
                if not dry_run:
                    path.unlink()
    return {"registry_root": text_of(state), "dry_run": dry_run, "removed": removed, "skipped": skipped}
