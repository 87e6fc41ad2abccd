"""Most frequent items by lossy counting in one pass over the rows as they lie, in memory that doesn't grow with the number of distinct values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.repeats import repeated
from ..storage import materialize


class LossyCounter:
    """Counts of the items of one stream whose true count is at most ``floor(epsilon * mass)`` above the kept one.

    An entry is ``[count, delta]``, where ``delta`` is the most that was lost before it was entered. At each boundary the
    entries with ``count + delta <= floor(epsilon * mass so far)`` are dropped.
    """

    def __init__(self, epsilon: float) -> None:
        self.epsilon, self.entries, self.mass, self.bound = epsilon, {}, 0, 0

    def add(self, items: list, counts: list[int], mass: int) -> None:
        """One bucket: its distinct items with their counts. ``mass`` also holds what belongs to no item."""
        entries, bound = self.entries, self.bound
        for x, n in zip(items, counts, strict=True):
            if (e := entries.get(x)) is not None:
                e[0] += n
            elif n > 0:
                entries[x] = [n, bound]
        self.mass += mass
        self.bound = b = math.floor(self.epsilon * self.mass)
        if b > bound:
            self.entries = {x: e for x, e in entries.items() if e[0] + e[1] > b}


_SCHEMA = "basis string, item string, low bigint, delta bigint, mass bigint, bound bigint"


def _summaries(rows: DataFrame, epsilon: float) -> DataFrame:
    """The summary of each partition of ``item, weight``: an entry a row, and a row without item for mass and bound."""
    width = math.ceil(1 / epsilon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {"rows": LossyCounter(epsilon), "weight": LossyCounter(epsilon)}
        for batch in batches:
            for lo in range(0, batch.num_rows, width):
                part = batch.slice(lo, width)
                coded = part.column(0).dictionary_encode()
                items = coded.dictionary.to_pylist()
                code = pc.fill_null(coded.indices, len(items)).to_numpy(zero_copy_only=False)
                weight = np.maximum(pc.fill_null(part.column(1), 0).to_numpy(zero_copy_only=False), 0)
                sums = np.zeros(len(items) + 1, np.int64)
                np.add.at(sums, code, weight)
                counters["rows"].add(items, np.bincount(code, minlength=len(items) + 1)[:-1].tolist(), part.num_rows)
                counters["weight"].add(items, sums[:-1].tolist(), int(weight.sum()))
        for basis, c in counters.items():
            for lo in range(0, len(c.entries) + 1, 10_000):
                own = list(c.entries.items())[lo : lo + 10_000]
                head = 1 if lo == 0 else 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "basis": pa.array([basis] * (head + len(own)), pa.string()),
                        "item": pa.array([None] * head + [x for x, _ in own], pa.string()),
                        "low": pa.array([0] * head + [e[0] for _, e in own], pa.int64()),
                        "delta": pa.array([0] * head + [e[1] for _, e in own], pa.int64()),
                        "mass": pa.array([c.mass] * head + [0] * len(own), pa.int64()),
                        # an entry takes its own partition's bound back, as its delta stands in its place
                        "bound": pa.array([c.bound] * head + [-c.bound] * len(own), pa.int64()),
                    }
                )

    return rows.mapInArrow(run, _SCHEMA)


def _columns(hits: DataFrame, key: str, item: str, weight: str) -> DataFrame:
    weight_ = F.greatest(F.coalesce(F.col(f"`{weight}`"), F.lit(0)), F.lit(0)).cast("bigint")
    return hits.select(
        F.col(f"`{key}`").alias("__k"), F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{weight}`").cast("bigint").alias("weight"),
        weight_.alias("w")
    )


def repeats_of(hits: DataFrame, *, key: str, item: str, weight: str) -> DataFrame:
    """``item, rows, w``: what repeated rows, told by key, item and weight, add to the rows and the weight of each item (null among them). Rows
    without a key can't be repeated ones.
    """
    rows = _columns(hits, key, item, weight).where("__k is not null")
    more = repeated(rows, ["__k", "item", "weight", "w"])
    return materialize(more.groupBy("item").agg(F.sum("__more").alias("rows"), F.sum(F.col("__more") * F.col("w")).alias("w")))


def frequent_items(hits: DataFrame, *, key: str, item: str, weight: str, share: float, epsilon: float, repeats: DataFrame | None = None) -> DataFrame:
    """``basis, item, low, high, mass``: every item whose share of the rows (``basis`` ``rows``) or of the summed weight (``weight``) may reach
    ``share``, with bounds that hold its true figure.

    Each partition keeps a lossy count of its rows and of their weight, as they are read; the summaries are merged by adding counts and deltas, an
    absent item counting with its partition's whole bound. Repeated rows (same key) count once: what they add (``repeats``, of :func:`repeats_of`) is
    taken off bounds and mass. ``high - low`` is at most ``epsilon`` of the mass with repeats. No item that reaches ``share`` is absent. A null item
    counts in the mass only; a null or negative weight is 0. An empty table gives no rows.
    """
    if not 0 < epsilon < share < 1:
        raise ValueError("0 < epsilon < share < 1 must hold")
    more = repeats_of(hits, key=key, item=item, weight=weight) if repeats is None else repeats
    parts = materialize(_summaries(_columns(hits, key, item, weight).select("item", F.col("w").alias("weight")), epsilon))
    # a row for each basis
    off = F.array(*[F.struct(F.lit(b).alias("basis"), F.col(c).alias("off")) for b, c in (("rows", "rows"), ("weight", "w"))])
    each = more.select("item", F.inline(off))
    gone = each.groupBy("basis").agg(F.sum("off").alias("gone"))
    total = parts.where("item is null").groupBy("basis").agg(F.sum("mass").alias("mass"), F.sum("bound").alias("lost"))
    total = total.join(F.broadcast(gone), "basis", "left").select("basis", "lost", (F.col("mass") - F.coalesce("gone", F.lit(0))).alias("mass"))
    merged = parts.where("item is not null").groupBy("basis", "item").agg(F.sum("low").alias("low"), F.sum(F.col("low") + F.col("delta") + F.col("bound")).alias("top"))
    least = F.ceil(F.lit(share) * F.col("mass") * (1 - 1e-12))
    may = merged.join(F.broadcast(total), "basis").select("basis", "item", "low", (F.col("top") + F.col("lost")).alias("high"), "mass").where(F.col("high") >= least)
    own = each.join(F.broadcast(may.select("basis", "item")) if _few(share, epsilon) else may.select("basis", "item"), ["basis", "item"], "left_semi")
    held = may.join(own, ["basis", "item"], "left").withColumn("off", F.coalesce("off", F.lit(0)))
    return held.select(
        "basis", "item", F.greatest(F.col("low") - F.col("off"), F.lit(0)).alias("low"), (F.col("high") - F.col("off")).alias("high"), "mass"
    ).where(F.col("high") >= least)


def _few(share: float, epsilon: float) -> bool:
    """Whether candidates may be sent to all tasks: each holds more than ``share - epsilon`` of a basis, so there are at most ``2 / (share -
    epsilon)``.
    """
    return math.ceil(2 / (share - epsilon)) <= 1_000_000


def exact_figures(
    hits: DataFrame, candidates: DataFrame, *, key: str, item: str, weight: str, share: float, epsilon: float, repeats: DataFrame | None = None
) -> DataFrame:
    """``candidates`` (of :func:`frequent_items`) with ``rows`` and ``weight`` as they are: one more scan, of which one sum a task and candidate is
    shuffled.
    """
    names = candidates.select("item").distinct()
    known = F.broadcast(names) if _few(share, epsilon) else names
    more = repeats_of(hits, key=key, item=item, weight=weight) if repeats is None else repeats
    every = _columns(hits, key, item, weight).select("item", F.lit(1).cast("bigint").alias("rows"), "w").unionByName(
        more.select("item", -F.col("rows").alias("rows"), -F.col("w").alias("w")).toDF("item", "rows", "w")
    )
    counted = every.join(known, "item", "left_semi").groupBy("item").agg(F.sum("rows").alias("rows"), F.sum("w").alias("weight"))
    return candidates.join(counted, "item")
