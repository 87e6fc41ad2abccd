"""Rows that stand more than once, found by shuffling one hash a row instead of the rows.

Where repeated rows are to count once, counts are taken over all rows, with map-side combining, and what the repeats add is taken
off again. Equal rows have equal hashes, so only rows whose hash recurs are looked at as they are; every other row stands alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: The most hashes (8 bytes each) that are sent to all tasks; beyond, rows are joined by hash.
MOST_CODES_SENT = 1_000_000


def code_of(rows: DataFrame, columns: list[str]) -> Column:
    """A 64-bit hash of the columns, in which nulls count, those inside arrays too."""
    parts: list[Column] = []
    for c in columns:
        x = F.col(f"`{c}`")
        parts += [x, x.isNull()]
        if rows.schema[c].dataType.typeName() == "array":
            parts += [F.size(x), F.when(F.exists(x, lambda e: e.isNull()), F.transform(x, lambda e: e.isNull()))]
    return F.xxhash64(*parts)


def recurring(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their hash ``__code``, and the hashes that recur (a superset of those of equal rows). A hash that a third of all rows have is
    combined before the shuffle.
    """
    coded = rows.withColumn("__code", code_of(rows, columns))
    codes = materialize(coded.groupBy("__code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__code"))
    return coded, F.broadcast(codes) if codes.count() <= MOST_CODES_SENT else codes


def repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The different rows of ``columns`` that stand more than once, with ``__more``, the number of their further copies. Only rows whose hash recurs
    are shuffled whole.
    """
    coded, codes = recurring(rows.select(*[F.col(f"`{c}`") for c in columns]), columns)
    own = coded.join(codes, "__code", "left_semi")
    return own.groupBy(*[F.col(f"`{c}`") for c in columns]).agg((F.count(F.lit(1)) - 1).alias("__more")).where("__more > 0")
