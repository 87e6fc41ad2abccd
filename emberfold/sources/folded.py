"""Folded text files: one stack a line, ``frame;frame;leaf WEIGHT``."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ApiError
from ..functions.exprs import MAX_DEPTH, MAX_WEIGHT
from ..operators import profile as P
from ..operators import tree as T
from ..operators.badrows import with_errors
from ..storage import materialize, ship


#: Fixed value: the largest weight that a line can state.
MOST_U64 = (1 << 64) - 1


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 512 * 1024 * 1024
    line_bytes: int = 8 * 1024 * 1024
    depth: int = MAX_DEPTH
    total_weight: int = MAX_WEIGHT
    frames: int = 2**32 - 1


@dataclass
class Profile:
    """An ingested profile. Stacks and frame ids are held in the shared folder; the tree's node ids are made when first asked for."""

    stacks: DataFrame
    ids: DataFrame
    total_weight: int
    unique_stacks: int
    max_depth: int
    frame_count: int
    meta: dict = field(default_factory=dict)
    _nodes: DataFrame | None = None

    def nodes(self) -> DataFrame:
        if self._nodes is None:
            self._nodes = materialize(T.node_ids(self.stacks, self.ids))
        return self._nodes


def folded_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, at, length``: each line, a struct that orders the lines of one file, and its bytes with the line feed. Only a line feed ends a line."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        (F.octet_length("value") + 1).alias("length")
    )


def parsed_lines(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``lines`` with ``__errors``, ``__blank``, ``__frames`` and ``__weight``. Too long a line (its line feed counts) and one that isn't UTF-8 are
    ``invalid_folded_line``; a weight must fit 64 bits without sign.
    """
    text = F.when((F.col("length") > limits.line_bytes) | ~F.is_valid_utf8("value"), F.lit("?")).otherwise(F.col("value"))
    return with_errors(lines.withColumns({"fmt": F.lit("folded"), "line": text}), max_weight=MOST_U64, max_depth=limits.depth)


def _without_last_feed(lines: DataFrame, path: str) -> DataFrame:
    """``lines`` of one file; if nothing ends its last line, that is one byte shorter."""
    if not (size := os.path.getsize(path)):
        return lines
    with open(path, "rb") as f:
        f.seek(size - 1)
        if f.read(1) == b"\n":
            return lines
    last = lines.agg(F.max("at").alias("at")).first()["at"]
    return lines.withColumn("length", F.col("length") - F.when((F.col("at.block") == last["block"]) & (F.col("at.row") == last["row"]), 1).otherwise(0))


def _at_most(at: Row) -> Column:
    return (F.col("at.block") < at["block"]) | ((F.col("at.block") == at["block"]) & (F.col("at.row") <= at["row"]))


def _overflow(good: DataFrame, sums: DataFrame) -> Row | None:
    """Where the weight of one stack first exceeds 64 bits, if it does; only stacks that do in the end are looked at again."""
    over = sums.where(F.col("weight") > F.expr(f"cast('{MOST_U64}' as decimal(38,0))")).select("frames")
    if over.isEmpty():
        return None
    running = F.sum(F.col("weight").cast("decimal(38,0)")).over(Window.partitionBy("frames").orderBy("at"))
    return good.join(over, "frames", "left_semi").withColumn("s", running).where(
        F.col("s") > F.expr(f"cast('{MOST_U64}' as decimal(38,0))")
    ).agg(F.min("at").alias("at")).first()["at"]


def read_profile(spark: SparkSession, path: str, limits: Limits = Limits(), meta: dict | None = None) -> Profile:
    """The profile of one file, which is parsed once. What first goes wrong in file order is raised: a line that can't be read, a frame name too many,
    a stack whose weight exceeds 64 bits; the total weight is held against its limit behind the last line. An empty file is a valid profile of
    weight 0.
    """
    ship(spark)
    if not os.path.exists(path):
        raise ApiError("profile_not_found", f"No profile at {path}", {"profile": path}, "Give the path of an existing file.")
    if (size := os.path.getsize(path)) > limits.file_bytes:
        raise ApiError(
            "profile_too_large", f"The profile has {size} bytes, more than {limits.file_bytes}", {"byte_len": size, "limit": limits.file_bytes},
            "Raise the limit or make a smaller profile."
        )
    lines = parsed_lines(_without_last_feed(folded_lines(spark, os.path.abspath(path)), path), limits)
    preview = F.when(F.size("__errors") > 0, F.regexp_replace(F.left(F.make_valid_utf8("value"), F.lit(200)), r"\p{Cc}", "�"))
    parsed = materialize(
        lines.select(
            "at", F.get("__errors", F.lit(0)).alias("code"), preview.alias("preview"), "__blank", F.col("__frames").alias("frames"),
            F.col("__weight").alias("weight")
        )
    )
    bad = parsed.where("code is not null").orderBy("at").limit(1).first()
    good = parsed.where("not __blank and code is null").select("frames", "weight", "at")
    if bad is not None:
        good = good.where(_at_most(bad["at"]))
    stacks = materialize(good.groupBy("frames").agg(F.sum(F.col("weight").cast("decimal(38,0)")).alias("weight"), F.min("at").alias("at")))
    ids = materialize(P.frame_ids(stacks, "at"))
    frames = ids.count()
    ends: list[tuple[Row, str, str, dict, str]] = []
    if bad is not None:
        ends.append((bad["at"], bad["code"], f"can't be read: {bad['code']}", {"preview": bad["preview"]}, "Correct the line, or make the profile again."))
    if frames > limits.frames:
        name = ids.where(F.col("frame_id") == limits.frames).first()["name"]
        at = stacks.where(F.array_contains("frames", name)).agg(F.min("at").alias("at")).first()["at"]
        ends.append((at, "too_many_frames", "has a frame name too many", {"limit": limits.frames}, "Make a profile with fewer frames."))
    if (at := _overflow(good, stacks)) is not None:
        ends.append((at, "weight_overflow", "takes the weight of its stack above 64 bits", {}, "Use a larger unit of weight."))
    if ends:
        at, code, message, details, hint = min(ends, key=lambda e: tuple(e[0]))
        number = parsed.where(_at_most(at)).count()
        raise ApiError(code, f"Line {number} {message}", {"line": number, **details}, hint)
    sums = stacks.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("frames")), F.lit(0)).alias("d")).first()
    if int(sums["w"]) > limits.total_weight:
        raise ApiError("weight_overflow", "The total weight is too large", {"total_weight": str(sums["w"]), "limit": limits.total_weight}, "Use a larger unit of weight.")
    return Profile(stacks.select("frames", F.col("weight").cast("bigint").alias("weight")), ids, int(sums["w"]), sums["n"], sums["d"], frames, meta or {})
