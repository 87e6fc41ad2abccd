"""A profile as DataFrames: unique stacks, frame identities and statistics, rankings, symbol context and comparison.

A profile is ``frames array<string>, weight bigint``, one row a unique stack with a weight of at least 1. Every function takes that and stays lazy, but for those that number rows, which sort them into the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent
from ..storage import materialize
from .numbering import MOST_NAMES_SENT, few, first_seen

UNKNOWN = "[unknown]"


def unique_stacks(rows: DataFrame, frames: str = "frames", weight: str = "weight") -> DataFrame:
    """Equal stacks summed. Rows with null or empty frames, a null frame, or a weight that is null or below 1 are no stacks."""
    f, w = F.col(f"`{frames}`"), F.col(f"`{weight}`")
    valid = rows.where(f.isNotNull() & (F.size(f) > 0) & (w >= 1) & ~F.exists(f, lambda x: x.isNull()))
    return valid.groupBy(f.alias("frames")).agg(F.sum(w).cast("bigint").alias("weight"))


def weight_of(stacks: DataFrame) -> Column:
    """The summed weight, 0 without stacks, as a scalar subquery."""
    return stacks.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint")).scalar()


def totals(stacks: DataFrame) -> DataFrame:
    """One row: ``total_weight, unique_stack_count, max_depth``, all 0 for an empty profile."""
    return stacks.agg(
        F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("total_weight"), F.count(F.lit(1)).alias("unique_stack_count"), F.coalesce(F.max(F.size("frames")), F.lit(0)).cast("bigint").alias("max_depth")
    )


def frame_ids(stacks: DataFrame, line: str = "frames") -> DataFrame:
    """``frame_id, name``: ids from 0 by first appearance, in the order of ``line`` and then of the place in the stack.

    ``line`` is the line number of a file, or anything that orders the stacks, such as the stack itself; stacks that order themselves aren't copied to
    each of their frames where the names are few enough to be sent.
    """
    if line == "frames":
        names = materialize(stacks.select(F.explode("frames").alias("name")).distinct())
        if few(names, MOST_NAMES_SENT):
            sent = stacks.sparkSession.sparkContext.broadcast(sorted((r["name"] for r in names.collect()), key=str.encode))
            return numbered_by(first_seen(stacks, sent), "at", "frame_id").select("frame_id", "name")
    seen = stacks.select(F.col(line).alias("line"), F.posexplode("frames").alias("pos", "name"))
    first = seen.groupBy("name").agg(F.min(F.struct("line", "pos")).alias("at"))
    return numbered_by(first, "at", "frame_id").select("frame_id", "name")


def numbered_by(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their place from 0 in the order of ``order``, whose values differ, without one task that sees all: sorted by ranges, counted by
    range, and shifted.
    """
    parts = rows.sparkSession.sparkContext.defaultParallelism
    local = rows.repartitionByRange(parts, order).sortWithinPartitions(order).select(
        "*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")
    )
    fixed = materialize(local)
    # one row a range
    sizes = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).drop("n")
    return fixed.join(F.broadcast(sizes), "__part").withColumn(name, (F.col("__row") + F.col("__before")).cast("bigint")).drop("__part", "__row", "__before", order)


def frame_stats(stacks: DataFrame, *by: str) -> DataFrame:
    """``[by,] name, self_weight, inclusive_weight, stack_count``: each stack counts once for a frame, however often it recurs there; self weight is
    that of the stacks it ends.
    """
    leaf = F.element_at("frames", -1)
    each = stacks.select(*by, "weight", leaf.alias("leaf"), F.explode(F.array_distinct("frames")).alias("name"))
    return each.groupBy(*by, "name").agg(
        F.sum(
            F.when(F.col("name") == F.col("leaf"), F.col("weight")).otherwise(F.lit(0))
        ).cast("bigint").alias("self_weight"), F.sum("weight").cast("bigint").alias("inclusive_weight"), F.count(F.lit(1)).alias("stack_count")
    )


def ranked(stats: DataFrame, metric: str, total: Column | int, scope: Column | int) -> DataFrame:
    """Frame rows with both percentages of ``metric``."""
    w = F.col(metric)
    value = lambda x: F.lit(x) if isinstance(x, int) else x
    return stats.select(
        "name", "self_weight", "inclusive_weight", "stack_count", percent(w, value(total)).alias("profile_percent"),
        percent(w, value(scope)).alias("scope_percent")
    )


def order_of(metric: str) -> list[Column]:
    return [F.desc(metric), F.desc("self_weight"), F.asc("name")]


def numbered(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their ``rank``; at most ``limit`` rows are ranked in one task."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def containing(stacks: DataFrame, name: str) -> DataFrame:
    return stacks.where(F.array_contains("frames", name))


def with_scope(stats: DataFrame, stacks: DataFrame, in_scope: DataFrame) -> DataFrame:
    """``stats`` with ``total`` and ``scope``, the weights of both sets of stacks."""
    return stats.withColumns({"total": weight_of(stacks), "scope": weight_of(in_scope)})


def top(stacks: DataFrame, metric: str = "self_weight", limit: int = 20, focus: str | None = None, name_regex: str | None = None) -> DataFrame:
    """``rank`` and frame rows by a metric. ``focus`` keeps only stacks with that frame, for figures and scope alike; ``name_regex`` drops rows, never
    weight.
    """
    own = stacks if focus is None else containing(stacks, focus)
    stats = frame_stats(own)
    if name_regex is not None:
        stats = stats.where(F.col("name").rlike(name_regex))
    held = with_scope(numbered(stats, order_of(metric), limit), stacks, own)
    w = F.col(metric)
    return held.select(
        "rank", "name", "self_weight", "inclusive_weight", "stack_count", percent(w, F.col("total")).alias("profile_percent"),
        percent(w, F.col("scope")).alias("scope_percent")
    )


def neighbours(stacks: DataFrame) -> DataFrame:
    """``name, side, other, weight``: the weight of the stacks where ``other`` directly calls (``side`` ``caller``) or is called by (``callee``)
    ``name``, each stack once for a pair.
    """
    n = F.size("frames")
    pairs = F.array_distinct(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("frames", i).alias("up"), F.element_at("frames", i + 1).alias("down")))
    )
    each = stacks.where(n > 1).select("weight", F.explode(pairs).alias("p")).groupBy("p.up", "p.down").agg(F.sum("weight").cast("bigint").alias("weight"))
    both = F.array(
        F.struct(F.col("down").alias("name"), F.lit("caller").alias("side"), F.col("up").alias("other")),
        F.struct(F.col("up").alias("name"), F.lit("callee").alias("side"), F.col("down").alias("other"))
    )
    return each.select(F.explode(both).alias("e"), "weight").select("e.name", "e.side", "e.other", "weight")


def symbol_context(stacks: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` heaviest neighbours of each frame and side, with their ``rank``."""
    rank = F.expr("row_number() over (partition by name, side order by weight desc, other)")
    return neighbours(stacks).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)


def find(stacks: DataFrame, query: str, mode: str = "contains", limit: int = 20) -> DataFrame:
    """Frames whose name contains ``query`` or matches it as a regular expression, by inclusive weight. An empty query fits all."""
    fits = F.contains("name", F.lit(query)) if mode == "contains" else F.col("name").rlike(query)
    held = with_scope(numbered(frame_stats(stacks).where(fits), order_of("inclusive_weight"), limit), stacks, stacks)
    w = F.col("inclusive_weight")
    return held.select(
        "rank", "name", "self_weight", "inclusive_weight", "stack_count", percent(w, F.col("total")).alias("profile_percent"),
        percent(w, F.col("scope")).alias("scope_percent")
    )


def diff(base: DataFrame, candidate: DataFrame, metric: str = "self_weight", sort: str = "regression", limit: int = 30, name_regex: str | None = None) -> DataFrame:
    """``rank, name, baseline_weight, candidate_weight, baseline_percent, candidate_percent, delta_pp`` of all names of either side; percentages are
    of each side's own total.
    """
    sides = []
    for x, p in ((base, "baseline"), (candidate, "candidate")):
        sides.append(frame_stats(x).select("name", F.col(metric).alias(f"{p}_weight")))
    joined = sides[0].join(sides[1], "name", "full_outer").na.fill(0, ["baseline_weight", "candidate_weight"])
    if name_regex is not None:
        joined = joined.where(F.col("name").rlike(name_regex))
    held = joined.withColumns({"baseline_total": weight_of(base), "candidate_total": weight_of(candidate)})
    rows = held.select(
        "name", "baseline_weight", "candidate_weight", percent(F.col("baseline_weight"), F.col("baseline_total")).alias("baseline_percent"),
        percent(F.col("candidate_weight"), F.col("candidate_total")).alias("candidate_percent")
    )
    rows = rows.withColumn("delta_pp", F.col("candidate_percent") - F.col("baseline_percent"))
    order = {"regression": F.desc("delta_pp"), "improvement": F.asc("delta_pp"), "absolute": F.desc(F.abs("delta_pp"))}[sort]
    return numbered(rows, [order, F.asc("name")], limit)
