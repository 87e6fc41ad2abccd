"""Rows that fail to parse, kept apart from the valid ones with the reason.

Every column is read as nullable text; the cast and constraint rules are columns of one projection whose
failures form an array, in the order of the rules. A row is valid if its array is empty. There is no
shuffle and no Python in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MAX_DEPTH, MAX_WEIGHT, folded_parts, weight_digits

#: Stands for a comma inside quotes while a line is split; a noncharacter, so no text for interchange holds it.
_MASK = "￿"


def _csv(line: Column) -> tuple[Column, Column]:
    """The fields as they stand, quotes included and quoted commas masked, and whether the quoting is broken.

    Quotes toggle, so a field is well quoted exactly if it is a row of closed pieces and nothing else; a doubled quote ends one piece and begins the
    next.
    """
    pieces = F.split(line, '"', -1)
    masked = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.translate(x, ",", _MASK)).otherwise(x)), '"')
    has_quote = F.contains(line, F.lit('"'))
    fields = F.split(F.when(has_quote, masked).otherwise(line), ",", -1)
    odd = F.exists(fields, lambda x: F.contains(x, F.lit('"')) & (~F.startswith(x, F.lit('"')) | (F.regexp_replace(x, '"[^"]*+"', "") != "")))
    return fields, has_quote & ((F.size(pieces) % 2 == 0) | odd)


def _value(field: Column) -> Column:
    quoted = F.replace(F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"')), F.lit(_MASK), F.lit(","))
    return F.when(F.startswith(field, F.lit('"')), quoted).otherwise(field)


def with_errors(raw: DataFrame, *, fmt: str = "fmt", line: str = "line", max_weight: int = MAX_WEIGHT, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``raw`` with ``__errors`` (reasons in the order of the rules), ``__blank``, ``__frames``, ``__weight``, ``__csv_profile`` and ``__csv_stack``.

    ``fmt`` is ``folded`` (``stack WS weight``) or ``csv`` (``profile_id,stack_id,stack,weight``, fields may stand in double quotes). Rules in order:
    ``unknown_format`` (null or any other format); for csv ``broken_quoting``, ``column_count``; for folded ``invalid_folded_line`` without whitespace
    before a weight; then for both ``invalid_folded_line`` (empty stack), ``invalid_weight`` (not ASCII digits after at most one plus, or zero),
    ``weight_overflow``, ``invalid_folded_line`` (an empty frame), ``stack_too_deep``. A null line and a folded line of whitespace only are blank: no
    record and no failure. ``__weight`` is a bigint, or a decimal if ``max_weight`` is larger than one.
    """
    kind = "bigint" if max_weight < 1 << 63 else "decimal(20,0)"
    text, form = F.col(f"`{line}`"), F.col(f"`{fmt}`")
    folded, csv = form.eqNullSafe("folded"), form.eqNullSafe("csv")
    kept, folded_stack, folded_weight = folded_parts(text)
    fields, broken = _csv(text)
    split = raw.withColumns(
        {
            "__fields": F.when(csv, fields),
            "__broken": F.coalesce(csv & broken, F.lit(False)),
            "__blank": text.isNull() | (folded & (kept == "")),
            "__folded_stack": F.when(folded, folded_stack),
            "__folded_weight": F.when(folded, folded_weight),
        }
    )
    count = F.size("__fields")
    at = lambda i: F.when(~F.col("__broken") & (count == 4), _value(F.get("__fields", F.lit(i))))
    parts = split.withColumns(
        {
            "__csv_profile": at(0),
            "__csv_stack": at(1),
            "__stack": F.when(csv, at(2)).otherwise(F.col("__folded_stack")),
            "__weight_text": F.when(csv, at(3)).otherwise(F.col("__folded_weight")),
        }
    )
    known = parts.withColumns({"__all": F.split("__stack", ";", -1), "__digits": weight_digits(F.col("__weight_text"))})
    stack, digits, frames = F.col("__stack"), F.col("__digits"), F.col("__all")
    over = (F.length(digits) > len(str(max_weight))) | (F.expr(f"try_cast(__digits as {kind})") > F.expr(f"cast('{max_weight}' as {kind})"))
    fails = [
        (~folded & ~csv, "unknown_format"),
        (F.col("__broken"), "broken_quoting"),
        (csv & ~F.col("__broken") & (count != 4), "column_count"),
        (folded & stack.isNull(), "invalid_folded_line"),
        (stack == "", "invalid_folded_line"),
        (stack.isNotNull() & (digits.isNull() | (digits == "")), "invalid_weight"),
        (stack.isNotNull() & over, "weight_overflow"),
        (F.array_contains(frames, "") & (stack != ""), "invalid_folded_line"),
        (F.size(frames) > max_depth, "stack_too_deep"),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in fails]))
    # a generator, as a filter on its output isn't pushed below it, where every rule would be evaluated again for each use
    checked = known.select("*", F.inline(F.array(F.struct(F.when(F.col("__blank"), F.array().cast("array<string>")).otherwise(errors).alias("__errors")))))
    fine = (F.size("__errors") == 0) & ~F.col("__blank")
    return checked.withColumns({"__frames": F.when(fine, frames), "__weight": F.when(fine, F.expr(f"try_cast(__digits as {kind})"))}).drop(
        "__fields", "__broken", "__folded_stack", "__folded_weight", "__stack", "__weight_text", "__all", "__digits"
    )


def valid_records(raw: DataFrame, id_col: str = "raw_id", profile: str = "profile_id", **kw) -> DataFrame:
    """The records that parse: ``id, profile, stack_id, frames, weight``. The profile and the stack of a csv line are its own if they are whole
    numbers, else the row's and null.
    """
    own = F.expr("try_cast(__csv_profile as bigint)")
    return with_errors(raw, **kw).where("size(__errors) = 0 and not __blank").select(
        F.col(f"`{id_col}`"), F.coalesce(own, F.col(f"`{profile}`")).alias(profile), F.expr("try_cast(__csv_stack as bigint)").alias("stack_id"), F.col("__frames").alias("frames"), F.col("__weight").alias("weight")
    )


def failed_records(raw: DataFrame, id_col: str = "raw_id", **kw) -> DataFrame:
    """The lines that don't parse: ``id, reason`` (the first), ``reasons`` (all) and ``preview`` (200 characters, control characters replaced)."""
    line = kw.get("line", "line")
    return with_errors(raw, **kw).where("size(__errors) > 0").select(
        F.col(f"`{id_col}`"), F.get("__errors", F.lit(0)).alias("reason"), F.col("__errors").alias("reasons"), F.regexp_replace(
            F.left(F.col(f"`{line}`"), F.lit(200)), r"\p{Cc}", "�"
        ).alias("preview")
    )
