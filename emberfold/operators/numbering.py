"""The nodes of the calling-context tree in depth-first order, in one pass over sorted stacks.

A stack's key is the ids of its frames, four bytes each, high byte first, so keys sort as the arrays of ids do, and what is shuffled and sorted is
these keys only. In their order, the nodes that a stack opens are its prefixes beyond what it shares with the stack before, and a node's weight is that
of the stacks until one no longer has its prefix. Where a range of keys ends, the nodes that stay open, one chain a range, are all that the ranges
need of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: The most frame names, and the most bytes of them, that are sent to every task.
MOST_NAMES_SENT, MOST_BYTES_SENT = 200_000, 16_000_000

ID = np.dtype(">u4")


def few(names: DataFrame, most: int) -> bool:
    """Whether the column ``name`` has few enough names to be sent."""
    r = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("b")).first()
    return r["n"] <= most and r["b"] <= MOST_BYTES_SENT


def _keys(frames: pa.ListArray, names: pa.StringArray) -> pa.BinaryArray:
    places = pc.index_in(frames.flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(ID)
    edges = (frames.offsets.to_numpy() - frames.offsets[0].as_py()).astype(np.int32) * ID.itemsize
    return pa.Array.from_buffers(pa.binary(), len(frames), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(places)])


def keyed(stacks: DataFrame, names: Broadcast) -> DataFrame:
    """``key, weight`` of ``frames, weight``, where a frame's id is its place in ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names.value, pa.string())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_keys(batch.column(0), known), batch.column(1)], names=["key", "weight"])

    return stacks.select("frames", "weight").mapInArrow(run, "key binary, weight bigint")


def first_seen(stacks: DataFrame, names: Broadcast) -> DataFrame:
    """``name, at``: the first place of each name in the order of the stacks themselves. ``names`` are sorted. Each task tells its first places only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = pa.array(names.value, pa.string()), {}
        for batch in batches:
            keys = sorted(set(_keys(batch.column(0), known).to_pylist()))
            ids, first = np.unique(np.frombuffer(b"".join(keys), ID), return_index=True)
            ends = np.cumsum([len(k) // ID.itemsize for k in keys])
            rows = np.searchsorted(ends, first, "right")
            for i, r, f in zip(ids.tolist(), rows.tolist(), first.tolist(), strict=True):
                at = (keys[r], f - int(ends[r]) + len(keys[r]) // ID.itemsize)
                if i not in best or at < best[i]:
                    best[i] = at
        found = list(best.items())
        for lo in range(0, len(found), 500):
            part = found[lo : lo + 500]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names.value[i] for i, _ in part], pa.string()), pa.array([k for _, (k, _) in part], pa.binary()), pa.array([p for _, (_, p) in part], pa.int64())],
                names=["name", "key", "pos"]
            )

    each = stacks.select("frames").mapInArrow(run, "name string, key binary, pos bigint")
    return each.groupBy("name").agg(F.min(F.struct("key", "pos")).alias("at"))


def _shared(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each key but the first, how many ids it shares with the key before."""
    sizes = np.diff(edges)
    both = np.minimum(sizes[1:], sizes[:-1])
    at = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    apart = np.flatnonzero(flat[np.repeat(edges[:-2], both) + at] != flat[np.repeat(edges[1:-1], both) + at])
    row, first = np.unique(np.repeat(np.arange(len(both)), both)[apart], return_index=True)
    both[row] = at[apart[first]]
    return both


def _read(batch: pa.RecordBatch, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of ``last`` and of the batch's keys in a row, where each begins, and the weights."""
    raw = batch.column(0).to_pylist()
    flat = np.concatenate([last, np.frombuffer(b"".join(raw), ID).astype(np.int64)])
    edges = np.concatenate([[0, len(last)], len(last) + np.cumsum([len(k) // ID.itemsize for k in raw])])
    return flat, edges, batch.column(1).to_numpy()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: its first and last key, the nodes of its stacks, and the weight that each prefix of its first key has in it."""
    first = last = None
    nodes, low = 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, edges, weight = _read(batch, np.empty(0, np.int64) if last is None else last)
        shared = _shared(flat, edges)
        if first is None:
            first = flat[: edges[2]]
            part, low, held = batch.column(2)[0].as_py(), len(first), np.zeros(len(first) + 1, np.int64)
            nodes, shared[0] = low + 1, low
        nodes += int((np.diff(edges)[1:] - shared).sum())
        still = np.minimum(low, np.minimum.accumulate(shared))
        np.add.at(held, still, weight)
        low, last = int(still[-1]), flat[edges[-2] :]
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), *[pa.array([x.astype(ID).tobytes()], pa.binary()) for x in (first, last)], pa.array([nodes], pa.int64()),
                pa.array([np.cumsum(held[::-1])[::-1].tolist()], pa.list_(pa.int64()))
            ],
            names=["part", "first", "last", "nodes", "held"]
        )


def _joints(ends: list) -> dict[int, tuple[int, np.ndarray | None, np.ndarray]]:
    """Of each range: the id of the first node that it opens, the ids of the deepest node that is open before it (None if it is the first range), and
    what later ranges add to the weights of the nodes that stay open behind it, by depth.
    """
    keys = [[np.frombuffer(r[x], ID).astype(np.int64) for x in ("first", "last")] for r in ends]
    common = lambda a, b: int(_shared(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))[0])
    out, more = {}, np.zeros(0, np.int64)
    opened = [int(r["nodes"]) for r in ends]
    open_before: list[np.ndarray | None] = [None]
    for p in range(1, len(ends)):
        n = common(keys[p - 1][1], keys[p][0])
        open_before.append(keys[p][0][:n])
        opened[p] -= n + 1
    for p in range(len(ends) - 1, -1, -1):
        after = np.zeros(len(keys[p][1]) + 1, np.int64)
        after[: len(more)] = more
        out[ends[p]["part"]] = (sum(opened[:p]), open_before[p], after)
        if p:
            n = len(open_before[p]) + 1
            more = np.array(ends[p]["held"], np.int64)[:n]
            through = min(n, common(*keys[p]) + 1)
            more[:through] += after[:through]
    return out


def nodes_in_order(rows: DataFrame, names: Broadcast | None) -> DataFrame:
    """``path, self_weight, total_weight, node_id`` of the nodes of ``key, weight`` and, where ``names`` aren't sent, ``frames``; equal keys are summed. No
    task sees more than its range of keys, of which it holds one batch and one chain of open nodes.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the range as a column, since a task that reads it can have another number
    kept = ["key", "weight", F.spark_partition_id().alias("part"), *([] if names else ["frames"])]
    own = materialize(rows.repartitionByRange(parts, "key").sortWithinPartitions("key").select(*kept))
    ends = own.select("key", "weight", "part").mapInArrow(_ends, "part int, first binary, last binary, nodes bigint, held array<bigint>").orderBy("part").collect()
    joints = spark.sparkContext.broadcast(_joints(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names.value, pa.string()) if names else None
        last, line, so_far = None, b"", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                next_id, last, after = joints.value[batch.column(2)[0].as_py()]
                # of the open nodes, by depth: id (-1 if an earlier range has it), the weight before it, own weight, bytes of its path, which begins line
                ids = np.full(0 if last is None else len(last) + 1, -1)
                before, own_weight, bytes_ = (np.zeros(len(ids), np.int64) for _ in range(3))
                last = np.empty(0, np.int64) if last is None else last
            flat, edges, weight = _read(batch, last)
            shared, c = _shared(flat, edges), len(ids)
            if not c:
                shared[0] = -1
            sizes = np.diff(edges)[1:]
            new = sizes - shared
            at = np.cumsum(new) - new + c
            passed = so_far + np.concatenate([[0], np.cumsum(weight)])
            if known is not None:
                frames = known.take(pa.array(flat[edges[1] :]))
                frames = pa.ListArray.from_arrays(pa.array((edges[1:] - edges[1]).astype(np.int32)), frames)
            else:
                frames = batch.column(3)
            lengths = np.concatenate([[0], np.cumsum(pc.binary_length(frames.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
            owner = np.repeat(np.arange(batch.num_rows), new)
            depth = np.arange(len(owner)) - np.repeat(at - c, new) + shared[owner] + 1
            starts = edges[1:-1] - edges[1]
            bytes_ = np.concatenate([bytes_, np.maximum(lengths[starts[owner] + depth] - lengths[starts[owner]] - 1, 0)])
            ids = np.concatenate([ids, next_id + np.arange(len(owner))])
            before = np.concatenate([before, passed[owner]])
            own_weight = np.concatenate([own_weight, np.zeros(len(owner), np.int64)])
            end = np.full(len(ids), -1)
            place = np.zeros(max(int(sizes.max()), c) + 2, np.int64)
            place[:c] = np.arange(c)
            top = c - 1
            for s, n, a, w, p in zip(shared.tolist(), sizes.tolist(), at.tolist(), weight.tolist(), passed.tolist(), strict=False):
                if top > s:
                    end[place[s + 1 : top + 1]] = p
                place[s + 1 : n + 1] = np.arange(a, a + n - s)
                own_weight[place[n]] += w
                top = n
            so_far, next_id = int(passed[-1]), next_id + len(owner)
            still = place[: top + 1].copy()
            shown = ids >= 0
            shown[still] = False
            texts = pc.cast(pc.binary_join(frames, ";"), pa.binary())
            yield _lists(pa.concat_arrays([pa.array([line], pa.binary()), texts]), np.concatenate([np.zeros(c, np.int64), owner + 1])[shown], ids[shown], bytes_[shown], own_weight[shown], (end - before)[shown])
            ids, before, own_weight, bytes_ = ids[still], before[still], own_weight[still], bytes_[still]
            line, last = texts[-1].as_py(), flat[edges[-2] :]
        if last is not None:
            shown = ids >= 0
            yield _lists(pa.array([line], pa.binary()), np.zeros(int(shown.sum()), np.int64), ids[shown], bytes_[shown], own_weight[shown], (so_far - before + after)[shown])

    made = own.mapInArrow(run, "line binary, n array<struct<id:bigint,bytes:int,own:bigint,total:bigint>>").select("line", F.explode("n").alias("n"))
    return made.selectExpr("cast(substring(line, 1, n.bytes) as string) as path", "n.own as self_weight", "n.total as total_weight", "n.id as node_id")


def _lists(lines: pa.Array, owner: np.ndarray, ids: np.ndarray, bytes_: np.ndarray, own: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    """The nodes of each line, whose paths begin it; ``owner``, the lines' places, ascends."""
    edges = np.searchsorted(owner, np.arange(len(lines) + 1)).astype(np.int32)
    nodes = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(bytes_.astype(np.int32), pa.int32()), pa.array(own, pa.int64()), pa.array(total, pa.int64())], names=["id", "bytes", "own", "total"])
    return pa.RecordBatch.from_arrays([lines, pa.ListArray.from_arrays(pa.array(edges), nodes)], names=["line", "n"])
