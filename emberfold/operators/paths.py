"""The heaviest complete stacks through a frame, with display windows and one budget of frames over all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent
from .profile import containing, weight_of


@dataclass(frozen=True)
class FrameWindow:
    """What of a stack is shown: ``head`` or ``tail`` of ``lines`` frames, or ``around_target``: ``before`` the first and ``after`` the last
    occurrence.
    """

    mode: str
    lines: int = 0
    before: int = 0
    after: int = 0


def _range(window: FrameWindow | None, n: Column, first: Column, last: Column) -> tuple[Column, Column]:
    zero = F.lit(0)
    if window is None:
        return zero, n
    if window.mode == "head":
        return zero, F.least(n, F.lit(window.lines))
    if window.mode == "tail":
        return F.greatest(n - window.lines, zero), n
    return F.greatest(first - window.before, zero), F.least(n, last + 1 + window.after)


def selected_paths(stacks: DataFrame, name: str, limit: int = 10, window: FrameWindow | None = None, max_total_frames: int = 500) -> DataFrame:
    """All selected rows, also those without budget left: ``rank, frames, weight, target_positions, display_target_positions, total_depth,
    requested_start, requested_end, frame_start, frame_end, available``.

    Rows are the heaviest stacks with the frame, ties by their frames. The budget is spent in this order; the row that overflows it is cropped, at its
    end for a head, at its start for a tail, else around the first occurrence. Positions count from 0. No window or budget changes weights or the
    selection.
    """
    order = [F.desc("weight"), F.asc("frames")]
    own = stacks.where(F.array_contains("frames", name)).orderBy(*order).limit(limit)
    ranked = own.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    n = F.size("frames")
    places = ranked.withColumn("pos", F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("frames", i + 1) == name))
    first, last = F.element_at("pos", 1), F.element_at("pos", -1)
    lo, hi = _range(window, n, first, last)
    wanted = places.withColumns({"lo": lo, "hi": hi})
    before = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.col("hi") - F.col("lo")
    budget = wanted.withColumn("available", F.greatest(F.lit(max_total_frames) - before, F.lit(0)).cast("int")).withColumn("left", F.least(size, F.col("available")))
    if window is not None and window.mode == "head":
        start = F.col("lo")
    elif window is not None and window.mode == "tail":
        start = F.col("hi") - F.col("left")
    else:
        middle = first - F.floor(F.col("left") / 2).cast("int")
        start = F.greatest(F.col("lo"), F.least(middle, F.col("hi") - F.col("left")))
    start = F.when(F.col("left") == size, F.col("lo")).otherwise(start)
    shown = budget.withColumn("s", start).withColumn("e", F.col("s") + F.col("left"))
    inside = F.transform(F.filter("pos", lambda p: (p >= F.col("s")) & (p < F.col("e"))), lambda p: p - F.col("s"))
    long = lambda c: F.col(c).cast("bigint")
    return shown.select(
        "rank", F.slice("frames", F.col("s") + 1, F.col("left")).alias("frames"), "weight", F.col("pos").alias("target_positions"), inside.alias("display_target_positions"), n.cast("bigint").alias("total_depth"),
        long("lo").alias("requested_start"), long("hi").alias("requested_end"), long("s").alias("frame_start"), long("e").alias("frame_end"), long("available").alias("available"),
    )


def paths(stacks: DataFrame, name: str, **kw) -> DataFrame:
    """The rows of :func:`selected_paths` that the budget reaches, with both percentages and what was left out on either side."""
    rows = selected_paths(stacks, name, **kw).where("available > 0")
    held = rows.withColumns({"total": weight_of(stacks), "scope": weight_of(containing(stacks, name))})
    return held.select(
        "rank", "frames", "weight", percent(F.col("weight"), F.col("total")).alias("profile_percent"), percent(F.col("weight"), F.col("scope")).alias("scope_percent"), "target_positions", "display_target_positions", "total_depth",
        "requested_start", "requested_end", "frame_start", "frame_end", F.col("frame_start").alias("omitted_before"), (
            F.col("total_depth") - F.col("frame_end")
        ).alias("omitted_after"),
        (F.col("frame_start") - F.col("requested_start")).alias("budget_omitted_before"), (F.col("requested_end") - F.col("frame_end")).alias("budget_omitted_after"),
    )
