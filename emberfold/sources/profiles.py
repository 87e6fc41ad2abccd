"""Profiles derived from tables: any column sequence, or any ordered event sequence, can be a stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import unique_stacks
from ..operators.repeats import recurring
from .tables import table


def star(spark: SparkSession, d: str) -> DataFrame:
    """Region, nation, market segment, order priority and return flag of each line item; its quantity is the weight."""
    t = lambda name: table(spark, d, name)
    # summed by keys before the names come in, so what is grouped row by row is narrow
    sold = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .where("cast(l_quantity as bigint) >= 1")
        .groupBy("c_nationkey", "c_mktsegment", "o_orderpriority", "l_returnflag")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("weight"))
    )
    rows = sold.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return unique_stacks(rows.select(F.array("r_name", "n_name", "c_mktsegment", "o_orderpriority", "l_returnflag").alias("frames"), "weight"))


def events(spark: SparkSession, d: str, when: str = "true") -> DataFrame:
    """The event types of each user's day in order; each day weighs 1. A user's day is the unit, so no group grows with the table."""
    rows = table(spark, d, "events").where(when).groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
    days = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("frames"))
    return unique_stacks(days.select("frames", F.lit(1).alias("weight")))


def recorded(spark: SparkSession, d: str) -> DataFrame:
    """All stack records as one profile; repeated rows count once."""
    return unique_stacks(table(spark, d, "stack_records").select("profile_id", "stack_id", "frames", "weight").distinct())


def valid_records(spark: SparkSession, d: str) -> DataFrame:
    """The stack records that are stacks, repeated ones as often as they stand."""
    return table(spark, d, "stack_records").where("frames is not null and size(frames) > 0 and weight >= 1 and not exists(frames, x -> x is null)")


def different_records(spark: SparkSession, d: str) -> DataFrame:
    """``frames, weight`` of the stack records, of which stacks may be equal but no records; only records whose hash recurs are shuffled."""
    names = ["profile_id", "stack_id", "frames", "weight"]
    coded, codes = recurring(valid_records(spark, d).select(*names), names)
    again = coded.join(codes, "__code", "left_semi").select(*names).distinct()
    return coded.join(codes, "__code", "left_anti").select("frames", "weight").unionByName(again.select("frames", "weight"))


def recorded_by_profile(spark: SparkSession, d: str) -> DataFrame:
    """``profile_id, frames, weight`` of every profile's unique stacks."""
    rows = table(spark, d, "stack_records").where(
        "frames is not null and size(frames) > 0 and weight >= 1"
    ).select("profile_id", "stack_id", "frames", "weight").distinct()
    return rows.groupBy("profile_id", "frames").agg(F.sum("weight").cast("bigint").alias("weight"))
