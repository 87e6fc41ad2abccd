"""Statistics that follow folded files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.badrows import with_errors


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    return with_errors(lines.select(F.lit("folded").alias("fmt"), F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")))


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The records ``frames, weight`` of the files that arrive in ``folder``, as a stream. A stream can't stop at the first bad line as a file's
    reader does; :func:`arriving_failures` gives those lines.
    """
    return _checked(spark, folder).where("size(__errors) = 0 and not __blank").select(F.col("__frames").alias("frames"), F.col("__weight").alias("weight"))


def arriving_failures(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of arriving files that don't parse, as a stream of their own: ``file, reason, preview``."""
    preview = F.regexp_replace(F.left("line", F.lit(200)), r"\p{Cc}", "�")
    return _checked(spark, folder).where("size(__errors) > 0").select("file", F.get("__errors", F.lit(0)).alias("reason"), preview.alias("preview"))


def running_weights(records: DataFrame) -> DataFrame:
    """``name, self_weight, inclusive_weight`` over all records so far. Both are sums over records, so equal stacks need no joining; unlike these,
    ``stack_count`` would need all stacks as state.
    """
    each = records.select("weight", F.element_at("frames", -1).alias("leaf"), F.explode(F.array_distinct("frames")).alias("name"))
    return each.groupBy("name").agg(
        F.sum(F.when(F.col("name") == F.col("leaf"), F.col("weight")).otherwise(0)).cast("bigint").alias("self_weight"),
        F.sum("weight").cast("bigint").alias("inclusive_weight")
    )
