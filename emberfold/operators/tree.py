"""The calling-context tree and its budgeted pages, as sets of prefixes.

A node is a distinct prefix of stacks, told by a hash that each prefix makes of the one before, so the tree is one aggregation of narrow rows and
depth never means recursion; its path comes from one of its stacks. Depth-first order is the order of a key: the list, from the page's root down, of
each node's negative total and name. Sorting by it and taking the first nodes is what a walk with a node budget does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent, prefix_of
from ..storage import materialize
from .numbering import MOST_NAMES_SENT, few, keyed, nodes_in_order
from .profile import numbered_by, weight_of

CONTINUATIONS = 128


def _hashes(frames: str) -> str:
    """SQL for the 128-bit hashes ``a, b`` of all prefixes of ``frames``, from none to all, each made of the one before, which is ``ua, ub``, and one name."""
    none = "struct(0L as a, 0L as b, 0L as ua, 0L as ub)"
    last = "element_at(acc, -1)"
    step = f"struct(xxhash64({last}.a, x) as a, xxhash64('b', {last}.b, x) as b, {last}.a as ua, {last}.b as ub)"
    return f"aggregate({frames}, array({none}), (acc, x) -> concat(acc, array({step})))"


def _below(stacks: DataFrame, root: list[str]) -> DataFrame:
    """The stacks at or below ``root`` without it, each with a hash of its own."""
    own = stacks
    if root:
        own = stacks.where(F.slice("frames", 1, len(root)) == F.array(*[F.lit(x) for x in root]))
        own = own.select(F.slice("frames", F.lit(len(root) + 1), F.greatest(F.size("frames") - len(root), F.lit(0))).alias("frames"), "weight")
    # with the weight, so that both uses of the stacks need the same columns and one exchange serves both
    return own.select("frames", "weight", F.xxhash64("frames", "weight").alias("s"))


def hashed_nodes(own: DataFrame, levels: int | None = None) -> DataFrame:
    """``a, b, ua, ub, depth, self_weight, total_weight, s``: each node by the hashes of its path and of its parent's, with one stack that it stands
    in. What is shuffled is linear in the depth.
    """
    kept = "frames" if levels is None else f"slice(frames, 1, least(size(frames), {levels}))"
    each = own.selectExpr("weight", "s", "size(frames) as n", f"posexplode({_hashes(kept)}) as (depth, p)")
    each = each.selectExpr("p.a", "p.b", "p.ua", "p.ub", "depth", "weight", "s", "if(n = depth, weight, 0L) as ended")
    sums = ["first(ua) as ua", "first(ub) as ub", "first(depth) as depth", "cast(sum(ended) as bigint) as self_weight", "cast(sum(weight) as bigint) as total_weight", "min(s) as s"]
    return each.groupBy("a", "b").agg(*[F.expr(x) for x in sums])


def with_paths(found: DataFrame, own: DataFrame, *columns: Column | str) -> DataFrame:
    """``path`` and ``columns`` of nodes: each takes its path from its one stack; should two stacks have that stack's hash, the first half of the
    path's own tells which.
    """
    paths = found.join(own.drop("weight"), "s").selectExpr("*", "slice(frames, 1, depth) as path")
    return paths.where("aggregate(path, 0L, (h, x) -> xxhash64(h, x)) = a").select("path", *columns)


def nodes(stacks: DataFrame, root: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """``path, depth, self_weight, total_weight`` of each node at or below ``root``, down to ``levels`` below it; ``path`` and ``depth`` count from
    ``root``. The depth is bounded before stacks multiply.
    """
    own = _below(stacks, root or [])
    return with_paths(hashed_nodes(own, levels), own, F.col("depth").cast("bigint").alias("depth"), "self_weight", "total_weight")


def node_ids(stacks: DataFrame, ids: DataFrame) -> DataFrame:
    """``node_id, path, self_weight, total_weight`` of the whole tree: ids rank the nodes by the frame ids of their paths, the root being 0. ``ids``
    is ``frame_id, name``; equal stacks are summed.

    Stacks become keys of their frames' ids once, where the names are few enough to be sent (``MOST_NAMES_SENT``) without a shuffle; only keys are
    sorted, and paths are made last.
    """
    if few(ids, MOST_NAMES_SENT):
        sent = stacks.sparkSession.sparkContext.broadcast([r["name"] for r in ids.orderBy("frame_id").collect()])
        return nodes_in_order(keyed(stacks, sent).groupBy("key").agg(F.sum("weight").cast("bigint").alias("weight")), sent)
    coded = _coded(_below(stacks.groupBy("frames").agg(F.sum("weight").cast("bigint").alias("weight")), []), ids)
    return nodes_in_order(coded.selectExpr("unhex(array_join(transform(ids, x -> lpad(hex(x), 8, '0')), '')) as key", "weight", "frames"), None)


def stack_ids(stacks: DataFrame, ids: DataFrame) -> DataFrame:
    """``stack_id, frames, weight``: the stacks ranked from 0 by their frame ids. ``ids`` is ``frame_id, name``."""
    return numbered_by(_coded(_below(stacks, []), ids).select("ids", "frames", "weight"), "ids", "stack_id")


def _coded(own: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``ids``, the frame ids of each stack."""
    if not few(ids, MOST_NAMES_SENT):
        each = own.select("s", "weight", "frames", F.posexplode("frames").alias("pos", "name")).join(ids, "name").groupBy("s", "frames").agg(
            F.first("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("pos", "frame_id"))).alias("f")
        )
        return each.select("frames", "weight", "s", F.transform("f", lambda x: x["frame_id"]).alias("ids"))
    known = {r["name"]: r["frame_id"] for r in ids.collect()}
    sent = own.sparkSession.sparkContext.broadcast(known)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = pa.array(list(sent.value), pa.string()), pa.array(list(sent.value.values()), pa.int64())
        for batch in batches:
            frames = batch.column(0)
            own_ids = numbers.take(pc.index_in(frames.flatten(), value_set=names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pc.subtract(frames.offsets, frames.offsets[0]), own_ids)],
                names=["frames", "weight", "s", "ids"]
            )

    return own.mapInArrow(code, "frames array<string>, weight bigint, s bigint, ids array<bigint>")


def _page(stacks: DataFrame, root: list[str] | None, max_depth: int, max_nodes: int, min_percent: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rendered nodes with ``path`` and ``key``, all nodes down to one level below the page, and the stacks."""
    own = materialize(_below(stacks, root or []))
    every = hashed_nodes(own, max_depth + 1).withColumn("scope", weight_of(own))
    inside = every.withColumn("scope_percent", percent(F.col("total_weight"), F.col("scope")))
    inside = inside.withColumn("fits", (F.col("depth") == 0) | (F.col("scope_percent") >= min_percent))
    # in this order a node comes behind all heavier siblings, so only max_nodes of a parent can show; a parent's rows are cut before they are shuffled
    tied = F.rank().over(Window.partitionBy("ua", "ub", F.col("depth") == 0).orderBy(F.desc("total_weight")))
    shorter = inside.where((F.col("depth") <= max_depth) & F.col("fits")).withColumn("__r", tied).where(F.col("__r") <= max_nodes)
    candidates = materialize(with_paths(shorter, own, "a", "b", F.col("depth").cast("bigint").alias("depth"), "self_weight", "total_weight", "scope_percent"))
    steps = candidates.select(F.col("a").alias("x"), F.col("b").alias("y"), "path", F.expr(f"explode({_hashes('path')}) as p")).select("x", "y", "path", "p.a", "p.b")
    weighed = candidates.select("a", "b", F.col("depth").cast("int").alias("d"), F.col("total_weight").alias("t"))
    keys = steps.join(weighed, ["a", "b"]).groupBy("x", "y").agg(F.first("path").alias("path"), F.array_sort(F.collect_list(F.struct("d", "t"))).alias("k"))
    keys = keys.select(
        "x", "y",
        F.transform("k", lambda k: F.struct((-k["t"]).alias("t"), F.when(k["d"] > 0, F.get("path", k["d"] - 1)).alias("name"))).alias("key"),
        F.size("path").alias("n"), F.size("k").alias("m")
    )
    # a node whose ancestor was cut is cut
    first = keys.where("m = n + 1").orderBy("key").limit(max_nodes)
    shown = first.join(candidates, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))).drop("x", "y", "n", "m")
    return materialize(shown), inside, own


def tree_page(stacks: DataFrame, root: list[str] | None = None, max_depth: int = 4, max_nodes: int = 64, min_percent: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The rendered nodes ``rank, path, depth, self_weight, total_weight, scope_percent`` in depth-first order, heaviest child first, and the omitted
    children of rendered nodes ``path, depth, total_weight, scope_percent, reason, key``.

    The reason is the first that holds of ``depth_limit``, ``min_scope_percent`` (below ``min_percent``) and ``node_budget``; ``key`` orders them as a
    walk meets them. The root always shows.
    """
    shown, inside, own = _page(stacks, root, max_depth, max_nodes, min_percent)
    # at most max_nodes rows
    parents = F.broadcast(shown.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("key").alias("parent_key")))
    left = inside.where("depth > 0").join(parents, ["ua", "ub"]).join(F.broadcast(shown.select("a", "b")), ["a", "b"], "left_anti")
    reason = F.when(F.col("depth") > max_depth, "depth_limit").when(~F.col("fits"), "min_scope_percent").otherwise("node_budget")
    key = F.concat("parent_key", F.array(F.struct((-F.col("total_weight")).alias("t"), F.element_at("path", -1).alias("name"))))
    omitted = with_paths(left, own, F.col("depth").cast("bigint").alias("depth"), "total_weight", "scope_percent", reason.alias("reason"), key.alias("key"))
    rank = F.row_number().over(Window.orderBy("key")).cast("bigint")
    return shown.select(rank.alias("rank"), "path", "depth", "self_weight", "total_weight", "scope_percent"), omitted


def omitted_by_reason(omitted: DataFrame) -> DataFrame:
    return omitted.groupBy("reason").agg(F.count(F.lit(1)).alias("children"), F.sum("total_weight").cast("bigint").alias("weight"))


def continuations(omitted: DataFrame, limit: int = CONTINUATIONS) -> DataFrame:
    """The first omitted children in the order a walk meets them, with their ``rank``."""
    return omitted.orderBy("key").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("key")).cast("bigint")).drop("key")


def chains(stacks: DataFrame, name: str, upward: bool) -> DataFrame:
    """The stacks above the last (``upward``, leaf side first) or below the first occurrence of a frame, as a profile of its own; each stack counts
    once, also where nothing is left.
    """
    own = stacks.where(F.array_contains("frames", name))
    frames = F.reverse("frames") if upward else F.col("frames")
    rest = own.select(frames.alias("f"), "weight").select(F.slice("f", F.array_position("f", name).cast("int") + 1, F.size("f")).alias("frames"), "weight")
    return rest.groupBy("frames").agg(F.sum("weight").cast("bigint").alias("weight"))
