"""Results per key although a few keys hold most records.

Nothing is grouped by the skewed key before it is aggregated: each map task combines its (profile, frame) counts in a bounded
hash table that spills, and only these partial counts are shuffled, at most one a task and key. Repeated stacks are told by one
hash a row; what they count too often is taken off by counts of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import repeated

#: The most frame names that are sent to every task; beyond, the join is shuffled and adaptive execution splits hot names.
MOST_NAMES_SENT = 200_000


def _held(records: DataFrame, profile: str, frames: str) -> DataFrame:
    """``p, name, n``: for each record and frame 1, once however often the frame recurs in it, and for each repeated stack and frame the negative
    number of its further copies.
    """
    stacks = records.where(F.col(f"`{frames}`").isNotNull()).select(F.col(f"`{profile}`").alias("p"), F.col(f"`{frames}`").alias("f"))
    name = F.explode(F.array_distinct("f")).alias("name")
    every = stacks.select("p", F.lit(1).cast("bigint").alias("n"), name)
    often = repeated(stacks, ["p", "f"]).select("p", (-F.col("__more")).alias("n"), name)
    return every.unionByName(often).where("name is not null")


def stacks_per_frame(records: DataFrame, profile: str = "profile_id", frames: str = "frames") -> DataFrame:
    """``profile, name, stack_count``: the distinct non-null stacks of the profile that hold the frame, each once however often the frame recurs in
    it.

    Repeated rows and the same stack under another id count once. A null profile is a profile of its own; null frames inside a stack and empty stacks
    give no row.
    """
    return _held(records, profile, frames).groupBy("p", "name").agg(F.sum("n").alias("stack_count")).withColumnRenamed("p", profile)


def counts_that_disagree(records: DataFrame, frames: DataFrame, stored: DataFrame) -> DataFrame:
    """``profile_id, frame_id, stored_count, stack_count`` of each pair whose stored count isn't the true one.

    An absent row, an absent pair and a null count are 0. Repeated stored rows count once; if a pair is stored with several counts, it disagrees
    unless all are right, and the one reported is the largest that is wrong. Frames without an entry in ``frames`` have no id and can't be compared.
    """
    # a frame of every profile would make its name a hot key of a shuffled join; sent to all tasks only while counted to be small
    ids = frames.select("name", F.col("frame_id").alias("f")).distinct()
    small = frames.count() <= MOST_NAMES_SENT
    each = _held(records, "profile_id", "frames")
    if not small:  # names are combined before they are shuffled
        each = each.groupBy("p", "name").agg(F.sum("n").alias("n"))
    actual = each.join(F.broadcast(ids) if small else ids, "name").select("p", "f", "n", F.lit(None).cast("bigint").alias("held"))
    held = stored.select(
        F.col("profile_id").alias("p"), F.col("frame_id").alias("f"), F.lit(0).cast("bigint").alias("n"),
        F.coalesce(F.col("stack_count").cast("bigint"), F.lit(0)).alias("held")
    )
    joined = actual.unionByName(held).groupBy("p", "f").agg(F.sum("n").alias("actual"), F.min("held").alias("low"), F.max("held").alias("high"))
    low, high = F.coalesce("low", F.lit(0)), F.coalesce("high", F.lit(0))
    return joined.where((low != F.col("actual")) | (high != F.col("actual"))).select(
        F.col("p").alias("profile_id"), F.col("f").alias("frame_id"), F.when(high != F.col("actual"), high).otherwise(low).alias("stored_count"), F.col("actual").alias("stack_count")
    )
