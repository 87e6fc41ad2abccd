"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the folded format: what separates the weight, the largest total that JSON readers keep exact, the deepest stack.
FOLDED_WHITESPACE = " \t\f\r"
MAX_WEIGHT = 9007199254740991
MAX_DEPTH = 4096


def percent(weight: Column, scope: Column) -> Column:
    """``weight`` as a percentage of ``scope``, 0.0 where the scope is 0; multiplied before divided, as doubles."""
    return F.when(scope == 0, F.lit(0.0)).otherwise(weight.cast("double") * 100.0 / scope.cast("double"))


def prefix_of(frames: Column, length: Column) -> Column:
    """The first ``length`` frames; a negative length counts as 0."""
    return F.slice(frames, F.lit(1), F.greatest(length, F.lit(0)))


def folded_parts(line: Column) -> tuple[Column, Column, Column]:
    """Of a folded line: the line without trailing whitespace, its stack and its weight, both as text.

    The last run of whitespace separates. Without any, the stack is null and the weight is the whole line.
    """
    spaces = " " * len(FOLDED_WHITESPACE)
    kept = F.rtrim(line, F.lit(FOLDED_WHITESPACE))
    weight = F.substring_index(F.translate(kept, FOLDED_WHITESPACE, spaces), " ", -1)
    stack = F.when(F.length(weight) < F.length(kept), F.rtrim(F.left(kept, F.length(kept) - F.length(weight)), F.lit(FOLDED_WHITESPACE)))
    return kept, stack, weight


def weight_digits(weight: Column) -> Column:
    """The digits of a valid weight text without its sign and leading zeros; null if it isn't digits after at most one plus."""
    return F.when(weight.rlike(r"^\+?[0-9]+\z"), F.ltrim(F.regexp_replace(weight, r"^\+", ""), F.lit("0")))
