"""Ordered patterns of events that recur in many sequences, with gaps, by pivot-item partitioning.

Items are ranked by frequency. A pattern's pivot is its rarest item, so each pattern belongs to exactly one pivot: a sequence sends every frequent
pivot it holds the part of it that can matter there, i.e. its items that are at least as frequent, without those that add no pattern. Equal parts are
summed before they move. Each pivot's parts are mined alone, in several blocks of bounded size if they are many: what is frequent overall reaches its
share of the threshold in some block, and the exact figures of all such candidates are counted in a second pass over the blocks. A pivot of one block
needs no second pass.

Sequences and parts are bytes of small unsigned ranks; many are handled at once in flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.repeats import recurring
from ..storage import materialize, stored

#: The most places that are expanded at once while sequences are split.
MOST_PLACES = 2_000_000


def previous(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each place the last place before it of the same item in the same row, -1 if none. ``row`` ascends or descends."""
    out = np.full(len(code), -1, np.int64)
    if len(code):
        key = np.abs(row.astype(np.int64) - int(row[0])) * (int(code.max()) + 1) + code
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        out[order[1:][same]] = order[:-1][same]
    return out


def _completes(code: np.ndarray, row: np.ndarray, longest: int) -> np.ndarray:
    """The places at which some subsequence of up to ``longest`` items is first completed; the others can go together, as the leftmost way to any
    subsequence never takes them.

    A place completes one of n + 1 items if behind, or at, the last place of its item there is one that completes one of n.
    """
    before, places = previous(code, row), np.arange(len(code))
    ok = before < 0
    for _ in range(longest - 1):
        last = np.maximum.accumulate(np.where(ok, places, -1))
        ok = (before < 0) | (np.append(-1, last[:-1])[: len(code)] >= before)
    return ok


def shortened(code: np.ndarray, row: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows without places whose removal leaves all subsequences of up to ``longest`` items: first those the leftmost way never takes, then those
    the rightmost doesn't.
    """
    keep = _completes(code, row, longest)
    code, row = code[keep], row[keep]
    keep = _completes(code[::-1], row[::-1], longest)[::-1]
    return code[keep], row[keep]


def _within(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, and for each the range it is in."""
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) + np.repeat(begin - np.cumsum(size) + size, size), own


def parts_by_pivot(code: np.ndarray, row: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row and item of it as pivot, the part of the row that the pivot's patterns can stand in: ``row, pivot, size`` of each part and the
    items of all. Parts of fewer than ``shortest`` items hold none.
    """
    code, row = shortened(code, row, longest)
    rows = int(row[-1]) + 1 if len(row) else 0
    size = np.bincount(row, minlength=rows)
    begin = np.cumsum(size) - size
    at = np.flatnonzero(previous(code, row) < 0)
    total = np.cumsum(size[row[at]])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MOST_PLACES, "right")))
        own, pivot = row[at[lo:hi]], code[at[lo:hi]]
        place, pair = _within(begin[own], size[own])
        held = code[place] <= pivot[pair]
        items, pair = shortened(code[place[held]], pair[held], longest)
        n = np.bincount(pair, minlength=hi - lo)
        ok = n >= shortest
        yield own[ok], pivot[ok], n[ok], items[ok[pair]]
        lo = hi


def mine(
    code: np.ndarray, size: np.ndarray, count: np.ndarray, weight: np.ndarray, pivot: int, shortest: int, longest: int, least_count: float,
    least_weight: float
) -> list[tuple[tuple[int, ...], int, int]]:
    """Patterns with the pivot that reach ``least_count`` or ``least_weight`` in these parts, with both figures, by growing prefixes over all parts at
    once.

    A prefix is held as the parts it stands in and the places behind its first completion; one look at what follows counts all items that can be
    added. Memory is a few times that of ``code``.
    """
    end = np.cumsum(size)
    part = np.repeat(np.arange(len(size)), size)
    before = previous(code, part)
    last = np.full(len(size), -1, np.int64)
    at = np.flatnonzero(code == pivot)
    last[part[at]] = at
    found: list[tuple[tuple[int, ...], int, int]] = []

    def grow(prefix: tuple[int, ...], held: np.ndarray, place: np.ndarray, has: bool) -> None:
        # without the pivot, only what stands before its last place, or is that, leads to a pattern
        stop = end[held] if has else last[held] + 1
        to, own = _within(place, np.maximum(stop - place, 0))
        ok = before[to] < place[own]
        if not has and len(prefix) + 1 == longest:
            ok &= code[to] == pivot
        to, own = to[ok], held[own[ok]]
        order = np.argsort(code[to], kind="stable")
        to, own = to[order], own[order]
        x = code[to]
        starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        if not len(starts):
            return
        n, w = np.add.reduceat(count[own], starts), np.add.reduceat(weight[own], starts)
        stops = np.append(starts[1:], len(x))
        for k in np.flatnonzero((n > 0) & ((n >= least_count) | (w >= least_weight))).tolist():
            item = int(x[starts[k]])
            seq, with_pivot = (*prefix, item), has or item == pivot
            if with_pivot and len(seq) >= shortest:
                found.append((seq, int(n[k]), int(w[k])))
            if len(seq) < longest:
                grow(seq, own[starts[k] : stops[k]], to[starts[k] : stops[k]] + 1, with_pivot)

    grow((), np.arange(len(size)), end - size, False)
    return found


def support(code: np.ndarray, size: np.ndarray, count: np.ndarray, weight: np.ndarray, patterns: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """The figures of given patterns in these parts."""
    ends = np.cumsum(size)
    of: dict[int, np.ndarray] = {}
    out, done = [], {(): (np.arange(len(size)), ends - size)}
    for seq in patterns:
        for k in range(1, len(seq) + 1):
            if seq[:k] in done:
                continue
            held, place = done[seq[: k - 1]]
            if (at := of.get(seq[k - 1])) is None:
                at = of[seq[k - 1]] = np.append(np.flatnonzero(code == seq[k - 1]), len(code))
            to = at[np.searchsorted(at, place)]
            ok = to < ends[held]
            done[seq[:k]] = held[ok], to[ok] + 1
        held = done[seq][0]
        out.append((int(count[held].sum()), int(weight[held].sum())))
    return out


def _bytes_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The items of a column of bytes, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    items = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes() if data is not None and len(column) else b""
    return np.frombuffer(items, kind), np.diff(offsets) // kind.itemsize if len(column) else np.zeros(0, np.int64)


def _bytes_column(items: np.ndarray, size: np.ndarray, kind: np.dtype) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(size))) * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(items.astype(kind).tobytes())])


def frequent_subsequences(
    sequences: DataFrame, *, items: str = "frames", weight: str = "weight", count_share: tuple[int, int], weight_share: tuple[int, int], shortest: int = 3, longest: int = 4, block_bytes: int = 4 << 20
) -> DataFrame:
    """``steps`` (array of items, which are strings or bigints), ``support``, ``weight``, ``all_support``, ``all_weight``: every pattern of
    ``shortest`` to ``longest`` items that reaches either share of all sequences or of their weight.

    A sequence supports a pattern once if its items occur in this order, gaps allowed; an item may recur in a pattern. Shares are fractions
    (numerator, denominator) and compared exactly. Each row is a sequence of its own; one with null ``items`` counts for nothing, null items inside it
    are gaps, an empty one counts in the totals only, a null or negative weight is 0. An empty table gives no rows. ``block_bytes`` bounds the mean
    size of the different parts mined at once; blocks of one pivot are hashes of parts.
    """
    spark = sequences.sparkSession
    (cn, cd), (wn, wd) = count_share, weight_share
    item_kind = sequences.schema[items].dataType.elementType.simpleString()
    own = stored(
        sequences.where(F.col(f"`{items}`").isNotNull()).select(
            F.col(f"`{items}`").alias("items"), F.greatest(F.coalesce(F.col(f"`{weight}`"), F.lit(0)), F.lit(0)).cast("bigint").alias("w")
        )
    )
    schema = f"steps array<{item_kind}>, support bigint, weight bigint, all_support bigint, all_weight bigint"
    total = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    if not total.n:
        return spark.createDataFrame([], schema)
    # an item can be frequent only if it reaches a share itself, so there are at most (mean length) / share of them
    figures = own.select(F.explode(F.array_distinct("items")).alias("item"), "w").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    reaches = ((F.col("n") * cd >= total.n * cn) & (F.col("n") > 0)) | ((F.col("w") * wd >= total.w * wn) & (F.col("w") > 0))
    names = [r["item"] for r in figures.where(reaches & F.col("item").isNotNull()).orderBy(F.desc("n"), F.desc("w"), "item").select("item").toLocalIterator()]
    if not names:
        return spark.createDataFrame([], schema)
    ranks = spark.sparkContext.broadcast(names)
    kind, arrow_kind = np.dtype(np.min_scalar_type(len(names))), pa.int64() if isinstance(names[0], int) else pa.string()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(ranks.value, arrow_kind)
        for batch in batches:
            lists = batch.column(0)
            code, row = pc.index_in(lists.flatten(), value_set=known), pc.list_parent_indices(lists)
            there = pc.is_valid(code)
            code, row = (pc.filter(x, there).to_numpy(zero_copy_only=False) for x in (code, row))
            code, row = shortened(code.astype(kind), row, longest)
            size = np.bincount(row, minlength=batch.num_rows)
            ok = size >= shortest
            yield pa.RecordBatch.from_arrays([_bytes_column(code[ok[row]], size[ok], kind), pc.filter(batch.column(1), pa.array(ok))], names=["seq", "w"])

    coded = own.mapInArrow(encode, "seq binary, w bigint").groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, size = _bytes_of(batch.column(0), kind)
            n, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for row, pivot, sizes, flat in parts_by_pivot(code, np.repeat(np.arange(len(size)), size), shortest, longest):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot.astype(np.int32)), _bytes_column(flat, sizes, kind), pa.array(n[row]), pa.array(w[row])],
                    names=["pivot", "part", "n", "w"]
                )

    moved = coded.mapInArrow(split, "pivot int, part binary, n bigint, w bigint")
    parts = materialize(moved.groupBy("pivot", "part").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    # one row a pivot; the totals tell whether a pivot can hold a frequent pattern at all
    sizes = parts.groupBy("pivot").agg(F.sum(F.octet_length("part")).alias("bytes"), F.sum("n").alias("n"), F.sum("w").alias("w")).collect()
    blocks = {r["pivot"]: -(-r["bytes"] // block_bytes) for r in sizes if r["n"] * cd >= total.n * cn or (r["w"] and r["w"] * wd >= total.w * wn)}
    if not blocks:
        return spark.createDataFrame([], schema)
    salts = F.broadcast(spark.createDataFrame(sorted(blocks.items()), "pivot int, blocks int"))
    placed = parts.join(salts, "pivot").withColumn("block", F.pmod(F.xxhash64("part"), F.col("blocks")).cast("int"))
    # more tasks than cores, as pivots differ in size, and never more than the session's partitions of a shuffle or blocks
    tasks = min(sum(blocks.values()), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.repartition(tasks, "pivot", "block")
    least_n, least_w = total.n * cn / cd * (1 - 1e-12), (total.w * wn / wd * (1 - 1e-12)) or float("inf")

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        part = table["part"].combine_chunks()
        return *_bytes_of(part, kind), table["n"].to_numpy(), table["w"].to_numpy()

    found_schema = "pivot int, blocks int, steps array<int>, n bigint, w bigint"

    def result(pivot: int, k: int, got: list[tuple[tuple[int, ...], int, int]]) -> pa.Table:
        columns = [[pivot] * len(got), [k] * len(got), [list(s) for s, _, _ in got], [n for _, n, _ in got], [w for _, _, w in got]]
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64()), strict=True)],
            names=["pivot", "blocks", "steps", "n", "w"]
        )

    def candidates(key: tuple, table: pa.Table) -> pa.Table:
        pivot, k = key[0].as_py(), table["blocks"][0].as_py()
        return result(pivot, k, mine(*arrays(table), pivot, shortest, longest, least_n / k, least_w / k))

    figured = placed.groupBy("pivot", "block").applyInArrow(candidates, found_schema)
    if max(blocks.values()) > 1:
        proposed = materialize(figured)

        def counted(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            seqs = sorted(tuple(s) for s in right["steps"].to_pylist()) if left.num_rows else []
            got = support(*arrays(left), seqs) if seqs else []
            return result(key[0].as_py(), 0, [(s, n, w) for s, (n, w) in zip(seqs, got, strict=True)])

        asked = proposed.where("blocks > 1").select("pivot", "steps", "blocks").distinct().select(
            "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "steps"
        )
        again = placed.where("blocks > 1").groupBy("pivot", "block").cogroup(asked.groupBy("pivot", "block")).applyInArrow(counted, found_schema)
        figured = proposed.where("blocks = 1").unionByName(again)
    summed = figured.groupBy("steps").agg(F.sum("n").alias("support"), F.sum("w").alias("weight"))
    frequent = summed.where((F.col("support") * cd >= total.n * cn) | ((F.col("weight") * wd >= total.w * wn) & (F.col("weight") > 0)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(ranks.value, arrow_kind)
        for batch in batches:
            steps = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(steps.offsets, known.take(steps.values)), batch.column(1), batch.column(2)],
                names=["steps", "support", "weight"]
            )

    spelled = frequent.mapInArrow(spell, f"steps array<{item_kind}>, support bigint, weight bigint")
    return spelled.select("steps", "support", "weight", F.lit(total.n).cast("bigint").alias("all_support"), F.lit(total.w).cast("bigint").alias("all_weight"))


def frequent_paths(records: DataFrame, **options) -> DataFrame:
    """:func:`frequent_subsequences` of the :func:`distinct_stacks` of ``records``."""
    return frequent_subsequences(distinct_stacks(records), **options)


def distinct_stacks(records: DataFrame) -> DataFrame:
    """``profile_id, frames, weight`` of each different stack; its weight is the sum over its different ``stack_id``, a null one 0. If an id has
    several weights the largest holds.

    Only stacks whose 64-bit hash recurs are shuffled; the others stand alone.
    """
    rows = records.where("frames is not null").select("profile_id", "frames", "stack_id", "weight")
    coded, codes = recurring(rows, ["profile_id", "frames"])
    again = coded.join(codes, "__code", "left_semi").groupBy("profile_id", "frames", "stack_id").agg(F.max("weight").alias("w")).groupBy("profile_id", "frames").agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("weight")
    )
    alone = coded.join(codes, "__code", "left_anti").select("profile_id", "frames", F.coalesce("weight", F.lit(0)).alias("weight"))
    return alone.unionByName(again)
