"""The eight questions about profiles, answered as bounded results with everything that was left out stated."""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .errors import ApiError
from .operators import profile as P
from .operators import tree as T
from .operators.paths import FrameWindow, paths, selected_paths
from .sources.folded import Limits, Profile, read_profile
from .storage import materialize

SCHEMA_VERSION = "2"
METRICS = {"self": "self_weight", "inclusive": "inclusive_weight"}
#: Fixed texts of the contract.
OPAQUE = "Weight unit is opaque; it is not assumed to be time or cycles."
NO_CAUSE = "Percentage-point changes do not prove causality or statistical significance."
NO_MATCH = "No exact frame identities matched; try a broader contains query or profile_find_symbols regex."
CONTEXT_ONLY = "folded_frames_and_observed_context_only"


def _pct(w: int, scope: int) -> float:
    return w * 100.0 / scope if scope else 0.0


def _between(value: int, low: int, high: int, name: str) -> None:
    if not low <= value <= high:
        raise ApiError("invalid_budget", f"{name} must be from {low} to {high}", {name: value, "min": low, "max": high}, "Use a value in the documented range.")


def _one_of(value: str, choices: Any, name: str) -> None:
    if value not in choices:
        raise ApiError("invalid_budget", f"{name} must be one of {', '.join(choices)}", {name: value}, "Use a documented value.")


def _tree_budget(depth: int, nodes: int, percent: float) -> None:
    _between(depth, 0, 16, "max_depth")
    _between(nodes, 1, 512, "max_nodes")
    if not (math.isfinite(percent) and 0 <= percent <= 100):
        raise ApiError("invalid_budget", "min_scope_percent must be from 0 to 100", {"min_scope_percent": percent}, "Use a value in the documented range.")


def _row_limit(limit: int, available: int) -> list[dict]:
    return [{"kind": "row_limit", "limit": limit, "returned": limit, "available": available, "omitted": available - limit}] if available > limit else []


class Engine:
    """Answers questions about the profiles registered in a workspace, or about profiles given directly. Profiles that were read are kept while they
    are among the ``kept`` last used.
    """

    def __init__(self, spark: SparkSession, workspace: str | Path = ".", kept: int = 8, limits: Limits = Limits()) -> None:
        if kept < 1:
            raise ApiError("invalid_budget", "The cache must hold at least one profile", {"cache_capacity": kept})
        self.spark, self.workspace, self.limits, self.kept = spark, Path(workspace), limits, kept
        self._read: OrderedDict[tuple, Profile] = OrderedDict()

    def load(self, profile: str | Profile | None = None) -> Profile:
        """A profile by alias, the active one for None; the registry is looked up at each call."""
        if isinstance(profile, Profile):
            return profile
        alias, entry, path = registry.resolve(self.workspace, profile, self.limits.file_bytes)
        stat = path.stat()
        key = (str(path), stat.st_size, stat.st_mtime_ns)
        if key not in self._read:
            if registry.fingerprint(path) != entry["fingerprint"]:
                raise ApiError("registry_corrupt", "A stored profile isn't what was registered", {"alias": alias}, "Register the profile again.")
            meta = {
                "canonical_path": registry.text_of(path.resolve()), "fingerprint": entry["fingerprint"], "byte_len": stat.st_size,
                "modified_unix_ms": stat.st_mtime_ns // 1_000_000, "alias": alias
            }
            self._read[key] = read_profile(self.spark, str(path), self.limits, meta)
            while len(self._read) > self.kept:
                self._read.popitem(last=False)
        self._read.move_to_end(key)
        return self._read[key]

    @staticmethod
    def _envelope(p: Profile, scope: int, reasons: list, warnings: list, data: dict) -> dict:
        return {
            "schema_version": SCHEMA_VERSION, "profile": p.meta, "scope_weight": scope, "truncated": bool(reasons), "truncation_reasons": reasons,
            "warnings": warnings, "data": data
        }

    @staticmethod
    def _ids(p: Profile, names: set[str]) -> dict[str, int]:
        return {r["name"]: r["frame_id"] for r in p.ids.where(F.col("name").isin(sorted(names))).collect()} if names else {}

    def _pattern(self, pattern: str) -> str:
        """The pattern for Java with Unicode classes, a dot for all but the line feed and ``$`` at the very end; look-around and references to groups
        aren't part of the dialect.
        """
        if len(pattern.encode()) > 4096:
            raise ApiError("invalid_regex", "The pattern is longer than 4 KiB", {"length": len(pattern.encode())}, "Use a shorter pattern.")
        bare = re.sub(r"\\\\", "", pattern)
        bad = re.search(r"\(\?(?:<?[=!]|>)|\\[1-9]|\\k[<{']", bare) or re.search(r"(?<!\\)[*+?}]\+", bare)
        try:
            self.spark._jvm.java.util.regex.Pattern.compile(f"(?dU){pattern}")
        except Exception as e:
            raise ApiError("invalid_regex", "The pattern can't be compiled", {"pattern": pattern}, "Correct the pattern.") from e
        if bad:
            raise ApiError("invalid_regex", "Look-around and references to groups aren't supported", {"pattern": pattern}, "Use a pattern without them.")
        return f"(?dU){pattern}"

    def _frame(self, p: Profile, selector: dict) -> tuple[int, str]:
        given = {k: v for k, v in selector.items() if v is not None}
        if len(given) != 1 or next(iter(given)) not in ("frame_id", "frame_name"):
            raise ApiError("invalid_frame_selector", "Exactly one of frame_id and frame_name must be set", {}, "Set one of them.")
        (key, value), column = next(iter(given.items())), {"frame_id": "frame_id", "frame_name": "name"}[next(iter(given))]
        row = p.ids.where(F.col(column) == F.lit(value)).first()
        if row is None:
            raise ApiError("frame_not_found", f"No such frame: {value}", {key: value}, "Look frames up with profile_find_symbols.")
        return row["frame_id"], row["name"]

    def _frame_rows(self, p: Profile, rows: list, metric: str, scope: int) -> list[dict]:
        ids = self._ids(p, {r["name"] for r in rows})
        return [
            {
                "frame_id": ids[r["name"]], **{k: r[k] for k in ("name", "self_weight", "inclusive_weight", "stack_count")},
                "profile_percent": _pct(r[metric], p.total_weight), "scope_percent": _pct(r[metric], scope)
            } for r in rows
        ]

    def summary(self, profile: str | Profile | None = None) -> dict:
        p = self.load(profile)
        stats = P.frame_stats(p.stacks)
        top = {
            name: self._frame_rows(p, stats.orderBy(*P.order_of(m)).limit(5).collect(), m, p.total_weight) for name,
            m in (("top_self", "self_weight"), ("top_inclusive", "inclusive_weight"))
        }
        unknown = p.stacks.where(F.array_contains("frames", P.UNKNOWN)).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()["w"]
        data = {
            "total_weight": p.total_weight, "frame_count": p.frame_count, "unique_stack_count": p.unique_stacks, "max_depth": p.max_depth,
            "unknown_frame_weight": unknown, **top
        }
        reasons = []
        if not isinstance(profile, Profile):
            status = registry.status(self.workspace)
            entries, active = status["profiles"], status["active"]
            shown = ([e for e in entries if e["alias"] == active] + [e for e in entries if e["alias"] != active])[:100]
            data["registry"] = {**status, "profiles": shown, "profile_count": len(entries)}
            if len(entries) > 100:
                reasons = [{"kind": "registry_profile_limit", "limit": 100, "returned": 100, "available": len(entries), "omitted": len(entries) - 100}]
        return self._envelope(p, p.total_weight, reasons, [OPAQUE], data)

    def find_symbols(self, query: str, mode: str = "contains", limit: int = 20, profile: str | Profile | None = None) -> dict:
        p = self.load(profile)
        _one_of(mode, ("contains", "regex"), "mode")
        _between(limit, 1, 100, "limit")
        fits = F.contains("name", F.lit(query)) if mode == "contains" else F.col("name").rlike(self._pattern(query))
        stats = P.frame_stats(p.stacks).where(fits)
        available = p.ids.where(fits).count()
        rows = self._frame_rows(p, stats.orderBy(*P.order_of("inclusive_weight")).limit(limit).collect(), "inclusive_weight", p.total_weight)
        near = P.symbol_context(p.stacks).where(F.col("name").isin([r["name"] for r in rows])).orderBy("rank").collect() if rows else []
        ids = self._ids(p, {r["other"] for r in near})
        for r in rows:
            r["context_hint"] = {
                f"top_{side}s": [
                    {"frame_id": ids[x["other"]], "name": x["other"], "weight": x["weight"]} for x in near if x["name"] == r["name"] and x["side"] == side
                ] for side in ("caller", "callee")
            }
        return self._envelope(
            p, p.total_weight, _row_limit(limit, available), [] if rows else [NO_MATCH],
            {"query": query, "mode": mode, "symbol_metadata": CONTEXT_ONLY, "matches": rows}
        )

    def top(self, sort: str = "self", limit: int = 20, focus: dict | None = None, name_regex: str | None = None, profile: str | Profile | None = None) -> dict:
        p = self.load(profile)
        _one_of(sort, METRICS, "sort")
        _between(limit, 1, 200, "limit")
        frame = None if focus is None else self._frame(p, focus)
        pattern = None if name_regex is None else self._pattern(name_regex)
        own = p.stacks if frame is None else P.containing(p.stacks, frame[1])
        scope = p.total_weight if frame is None else own.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()["w"]
        stats = P.frame_stats(own)
        if pattern is not None:
            stats = stats.where(F.col("name").rlike(pattern))
        rows = stats.withColumn("available", stats.agg(F.count(F.lit(1))).scalar()).orderBy(*P.order_of(METRICS[sort])).limit(limit).collect()
        data = {"sort": sort, "focus": frame and frame[0], "rows": self._frame_rows(p, rows, METRICS[sort], scope)}
        return self._envelope(p, scope, _row_limit(limit, rows[0]["available"] if rows else 0), [], data)

    def tree(
        self, root_node_id: int = 0, profile_fingerprint: str | None = None, max_depth: int = 4, max_nodes: int = 64, min_scope_percent: float = 0.1,
        profile: str | Profile | None = None
    ) -> dict:
        p = self.load(profile)
        _tree_budget(max_depth, max_nodes, min_scope_percent)
        if root_node_id and profile_fingerprint != p.meta.get("fingerprint"):
            raise ApiError(
                "profile_changed", "Node ids hold for one fingerprint only", {"expected": profile_fingerprint, "actual": p.meta.get("fingerprint")},
                "Start again at node 0."
            )
        root = p.nodes().where(F.col("node_id") == root_node_id).first()
        if root is None and not (root_node_id == 0 and not p.unique_stacks):
            raise ApiError("invalid_node_id", f"No node {root_node_id}", {"node_id": root_node_id}, "Use a node id of a tree page.")
        path = root["path"].split(";") if root is not None and root["path"] else []
        shown, omitted = T.tree_page(p.stacks, path, max_depth, max_nodes, min_scope_percent)
        omitted = materialize(omitted)
        full = lambda rows: [";".join([*path, *r["path"]]) for r in rows]
        rows, reasons, next_ = shown.orderBy("rank").collect(), T.omitted_by_reason(omitted).orderBy("reason").collect(), T.continuations(omitted).orderBy("rank").collect()
        left = {
            tuple(r["parent"]): (r["n"], r["w"]) for r in omitted.groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("parent")).agg(
                F.count(F.lit(1)).alias("n"), F.sum("total_weight").alias("w")
            ).collect()
        }
        # at most 512 + 128 paths
        wanted = full(rows) + full(next_)
        node = {r["path"]: r["node_id"] for r in p.nodes().where(F.col("path").isin(wanted)).collect()} if p.unique_stacks else {"": 0}
        ids = self._ids(p, {w.rsplit(";", 1)[-1] for w in wanted if w})
        scope = rows[0]["total_weight"] if rows else 0
        made = self._nested(p, rows, left, scope, lambda q: (node[";".join([*path, *q])], [*path, *q]), ids) if rows else {
            "node_id": 0, "frame_id": None, "name": None, "self_weight": 0, "total_weight": 0, "profile_percent": 0.0, "scope_percent": 0.0,
            "omitted_children": 0, "omitted_weight": 0, "children": []
        }
        available = sum(r["children"] for r in reasons)
        continued = [
            {
                "node_id": node[w], "frame_id": ids[r["path"][-1]], "name": r["path"][-1], "reason": r["reason"], "profile_fingerprint": p.meta.get("fingerprint"), "total_weight": r["total_weight"],
                "profile_percent": _pct(r["total_weight"], p.total_weight), "scope_percent": r["scope_percent"],
            }
            for r, w in zip(next_, full(next_), strict=True)
        ]
        data = {
            "root": made, "continuations": continued, "continuations_truncated": available > len(continued), "continuation_limit": T.CONTINUATIONS,
            "continuations_available": available, "continuations_omitted": available - len(continued)
        }
        return self._envelope(p, scope, self._tree_reasons(reasons, max_depth, max_nodes, min_scope_percent), [], data)

    @staticmethod
    def _tree_reasons(reasons: list, depth: int, nodes: int, least: float) -> list[dict]:
        bound = {"depth_limit": {"max_depth": depth}, "node_budget": {"max_nodes": nodes}, "min_scope_percent": {"threshold": least}}
        return [{"kind": r["reason"], **bound[r["reason"]], "omitted_children": r["children"], "omitted_weight": r["weight"]} for r in reasons]

    @staticmethod
    def _nested(p: Profile, rows: list, left: dict, scope: int, place: Any, ids: dict[str, int]) -> dict:
        """Rows in depth-first order as one nested node."""
        made: dict[tuple, dict] = {}
        for r in rows:
            at = tuple(r["path"])
            node_id, whole = place(r["path"])
            n, w = left.get(at, (0, 0))
            name = whole[-1] if whole else None
            made[at] = {
                "node_id": node_id, "frame_id": None if name is None else ids[name], "name": name, "self_weight": r["self_weight"], "total_weight": r["total_weight"], "profile_percent": _pct(r["total_weight"], p.total_weight),
                "scope_percent": _pct(r["total_weight"], scope), "omitted_children": n, "omitted_weight": w, "children": [],
            }
            if at:
                made[at[:-1]]["children"].append(made[at])
        return made[()]

    def _directional(self, frame: dict, max_depth: int, max_nodes: int, min_scope_percent: float, profile: str | Profile | None, upward: bool) -> dict:
        p = self.load(profile)
        _tree_budget(max_depth, max_nodes, min_scope_percent)
        frame_id, name = self._frame(p, frame)
        shown, omitted = T.tree_page(T.chains(p.stacks, name, upward), None, max_depth, max_nodes, min_scope_percent)
        omitted = materialize(omitted)
        rows, reasons = shown.orderBy("rank").collect(), T.omitted_by_reason(omitted).orderBy("reason").collect()
        left = {
            tuple(r["parent"]): (r["n"], r["w"]) for r in omitted.groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("parent")).agg(
                F.count(F.lit(1)).alias("n"), F.sum("total_weight").alias("w")
            ).collect()
        }
        scope = rows[0]["total_weight"]
        ids = self._ids(p, {x for r in rows for x in r["path"][-1:]}) | {name: frame_id}
        root = self._nested(p, rows, left, scope, lambda q: (None, [name, *q]), ids)
        stats = P.frame_stats(p.stacks).where(F.col("name") == name).collect()
        return self._envelope(
            p, scope, self._tree_reasons(reasons, max_depth, max_nodes, min_scope_percent), [],
            {"frame": self._frame_rows(p, stats, "inclusive_weight", scope)[0], "root": root}
        )

    def callers(self, frame: dict, max_depth: int = 5, max_nodes: int = 64, min_scope_percent: float = 0.1, profile: str | Profile | None = None) -> dict:
        return self._directional(frame, max_depth, max_nodes, min_scope_percent, profile, True)

    def callees(self, frame: dict, max_depth: int = 5, max_nodes: int = 64, min_scope_percent: float = 0.1, profile: str | Profile | None = None) -> dict:
        return self._directional(frame, max_depth, max_nodes, min_scope_percent, profile, False)

    def paths(self, through: dict, limit: int = 10, max_total_frames: int = 500, frame_window: FrameWindow | None = None, profile: str | Profile | None = None) -> dict:
        p = self.load(profile)
        _between(limit, 1, 50, "limit")
        if (w := frame_window) is not None:
            _one_of(w.mode, ("head", "tail", "around_target"), "mode")
            if w.mode == "around_target":
                _between(w.before, 0, 4096, "before")
                _between(w.after, 0, 4096, "after")
                _between(w.before + w.after, 1, 8192, "before + after")
            else:
                _between(w.lines, 1, 4096, "lines")
        _between(max_total_frames, 1, 5000, "max_total_frames")
        frame_id, name = self._frame(p, through)
        args = {"limit": limit, "window": w, "max_total_frames": max_total_frames}
        own = P.containing(p.stacks, name).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("n")).first()
        chosen = selected_paths(p.stacks, name, **args).collect()
        rows = [r.asDict() for r in paths(p.stacks, name, **args).orderBy("rank").collect()]
        for r in rows:
            del r["rank"]
            r["requested_frame_start"], r["requested_frame_end"] = r.pop("requested_start"), r.pop("requested_end")
        reasons = _row_limit(limit, own["n"])
        cropped = [r for r in chosen if r["requested_start"] or r["requested_end"] < r["total_depth"]]
        if cropped:
            reasons.append(
                {
                    "kind": "frame_window", "mode": w.mode, "cropped_paths": len(cropped),
                    "total_omitted_before": sum(r["requested_start"] for r in cropped),
                    "total_omitted_after": sum(r["total_depth"] - r["requested_end"] for r in cropped)
                }
            )
        wanted, got = sum(r["requested_end"] - r["requested_start"] for r in chosen), sum(len(r["frames"]) for r in rows)
        budget = {
            "limit": max_total_frames, "available": wanted, "returned": got, "omitted": wanted - got, "selected_paths": len(chosen), "returned_paths": len(rows), "omitted_paths": len(chosen) - len(rows),
            "cropped_paths": sum(len(r["frames"]) < r["requested_frame_end"] - r["requested_frame_start"] for r in rows),
        }
        if wanted > got:
            reasons.append({"kind": "total_frame_budget", **budget})
        return self._envelope(p, own["w"], reasons, [], {"through": frame_id, "paths": rows, "total_frame_budget": budget})

    def diff(
        self, baseline: str | Profile, candidate: str | Profile, metric: str = "self", sort: str = "regression", limit: int = 30,
        name_regex: str | None = None
    ) -> dict:
        b, c = self.load(baseline), self.load(candidate)
        _one_of(metric, METRICS, "metric")
        _one_of(sort, ("regression", "improvement", "absolute"), "sort")
        _between(limit, 1, 200, "limit")
        pattern = None if name_regex is None else self._pattern(name_regex)
        rows: DataFrame = P.diff(b.stacks, c.stacks, METRICS[metric], sort, limit, pattern)
        names = b.ids.select("name").union(c.ids.select("name")).distinct()
        available = (names if pattern is None else names.where(F.col("name").rlike(pattern))).count()
        reasons = _row_limit(limit, available)
        return {
            "schema_version": SCHEMA_VERSION, "baseline": b.meta, "candidate": c.meta, "scope_weight": {
                "baseline": b.total_weight, "candidate": c.total_weight
            }, "truncated": bool(reasons), "truncation_reasons": reasons, "warnings": [NO_CAUSE],
            "data": {"metric": metric, "sort": sort, "rows": [{k: v for k, v in r.asDict().items() if k != "rank"} for r in rows.orderBy("rank").collect()]},
        }
