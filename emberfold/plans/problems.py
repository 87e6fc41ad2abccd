"""Queries of the problems solved in the core: p2, p3 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.badrows import failed_records, valid_records
from ..operators.difference import table_difference
from ..operators.skewed import counts_that_disagree, stacks_per_frame
from ..sources.folded import folded_lines, parsed_lines
from ..sources.tables import table
from ..storage import new_path

KEY, FIELDS = ["profile_id", "frame_id"], ["name", "self_weight", "inclusive_weight"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return table_difference(table(spark, d, "frame_rows"), table(spark, d, "frame_rows_copy"), KEY, FIELDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return failed_records(table(spark, d, "raw_stacks")).select("raw_id", "reason").distinct()


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    return valid_records(table(spark, d, "raw_stacks")).selectExpr("raw_id", "profile_id", "stack_id", "array_join(frames, ';') as stack", "weight")


def p3_previews(spark: SparkSession, d: str) -> DataFrame:
    return failed_records(table(spark, d, "raw_stacks")).select("raw_id", "preview")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    return counts_that_disagree(t("stack_records"), t("frames"), t("frame_stats")).select("profile_id", "frame_id").distinct()


def p5_stack_counts(spark: SparkSession, d: str) -> DataFrame:
    return stacks_per_frame(table(spark, d, "stack_records"))


def text_line_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The folded lines of raw_stacks, written as text files and read by the reader of such files: lines and weight by reason, ``valid`` and ``blank``
    among them.
    """
    path = new_path(spark, "text")
    table(spark, d, "raw_stacks").where("fmt = 'folded' and line is not null").select("line").write.option("lineSep", "\n").text(path)
    lines = parsed_lines(folded_lines(spark, path))
    reason = F.when(F.col("__blank"), "blank").otherwise(F.coalesce(F.get("__errors", F.lit(0)), F.lit("valid")))
    return lines.groupBy(reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("__weight"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("weight")
    )


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_valid, p3_previews, p5_found, p5_stack_counts, text_line_reasons)}

_PARSED = r"""WITH l AS (SELECT raw_id, profile_id, fmt, line, rtrim(line, chr(32) || chr(9) || chr(12) || chr(13)) AS kept FROM raw_stacks WHERE line IS NOT NULL),
s AS (SELECT *, CASE WHEN fmt = 'folded' THEN regexp_matches(kept, '[ \t\f\r]') END AS has_ws,
  CASE WHEN fmt = 'csv' THEN NOT regexp_full_match(line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') END AS broken FROM l),
f AS (SELECT *, CASE WHEN fmt = 'csv' AND NOT broken THEN regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) END AS q FROM s),
p AS (SELECT *, CASE WHEN fmt = 'folded' AND has_ws THEN regexp_extract(kept, '(?s)^(.*?)[ \t\f\r]+[^ \t\f\r]+$', 1)
    WHEN len(q) = 4 THEN CASE WHEN q[3][1] = '"' THEN replace(q[3][2:-2], '""', '"') ELSE q[3] END END AS stack,
  CASE WHEN fmt = 'folded' AND has_ws THEN regexp_extract(kept, '(?s)([^ \t\f\r]+)$', 1)
    WHEN len(q) = 4 THEN CASE WHEN q[4][1] = '"' THEN replace(q[4][2:-2], '""', '"') ELSE q[4] END END AS w FROM f),
v AS (SELECT *, string_split(stack, ';') AS fr, CASE WHEN regexp_full_match(w, '\+?[0-9]+') THEN ltrim(ltrim(w, '+'), '0') END AS digits FROM p),
r AS (SELECT *, CASE
  WHEN fmt = 'folded' AND kept = '' THEN NULL
  WHEN broken THEN 'broken_quoting' WHEN fmt = 'csv' AND len(q) <> 4 THEN 'column_count'
  WHEN fmt = 'folded' AND NOT has_ws THEN 'invalid_folded_line' WHEN stack = '' THEN 'invalid_folded_line'
  WHEN digits IS NULL OR digits = '' THEN 'invalid_weight'
  WHEN len(digits) > 16 OR try_cast(digits AS BIGINT) > 9007199254740991 THEN 'weight_overflow'
  WHEN list_contains(fr, '') THEN 'invalid_folded_line' WHEN len(fr) > 4096 THEN 'stack_too_deep' END AS reason FROM v)"""
_DIFFS = " UNION ALL ".join(
    f"SELECT profile_id, frame_id, '{c}' AS field FROM j WHERE in_a AND in_b AND a_{c} IS DISTINCT FROM b_{c}" for c in FIELDS
)
ORACLES = {
    "p2_found": f"""
WITH a AS (SELECT DISTINCT profile_id, frame_id, name AS a_name, self_weight AS a_self_weight, inclusive_weight AS a_inclusive_weight, true AS in_a FROM frame_rows),
b AS (SELECT DISTINCT profile_id, frame_id, name AS b_name, self_weight AS b_self_weight, inclusive_weight AS b_inclusive_weight, true AS in_b FROM frame_rows_copy),
j AS (SELECT * FROM a FULL JOIN b USING (profile_id, frame_id))
SELECT profile_id, frame_id, 'missing_in_copy' AS field FROM j WHERE in_b IS NULL
UNION ALL SELECT profile_id, frame_id, 'missing_in_base' AS field FROM j WHERE in_a IS NULL
UNION ALL {_DIFFS}""",
    "p5_found": """
WITH s AS (SELECT DISTINCT profile_id, frames FROM stack_records WHERE frames IS NOT NULL),
c AS (SELECT profile_id, name, count(*) AS n FROM (SELECT profile_id, unnest(list_distinct(frames)) AS name FROM s) GROUP BY ALL),
i AS (SELECT c.profile_id, f.frame_id, c.n FROM c JOIN frames f USING (name)),
h AS (SELECT DISTINCT profile_id, frame_id, coalesce(stack_count, 0) AS held FROM frame_stats)
SELECT DISTINCT profile_id, frame_id FROM i FULL JOIN h USING (profile_id, frame_id) WHERE coalesce(n, 0) <> coalesce(held, 0)""",
    "p5_stack_counts": """
WITH s AS (SELECT DISTINCT profile_id, frames FROM stack_records WHERE frames IS NOT NULL)
SELECT profile_id, name, count(*) AS stack_count FROM (SELECT profile_id, unnest(list_distinct(frames)) AS name FROM s) GROUP BY ALL""",
    "p3_found": _PARSED + " SELECT raw_id, reason FROM r WHERE reason IS NOT NULL",
    "p3_previews": _PARSED + r" SELECT raw_id, regexp_replace(left(line, 200), '\p{Cc}', '�', 'g') AS preview FROM r WHERE reason IS NOT NULL",
    "p3_valid": _PARSED
    + r""" SELECT raw_id, CASE WHEN fmt = 'csv' AND regexp_full_match(trim(p), '[+-]?[0-9]+') THEN coalesce(try_cast(trim(p) AS BIGINT), profile_id) ELSE profile_id END AS profile_id,
CASE WHEN fmt = 'csv' AND regexp_full_match(trim(k), '[+-]?[0-9]+') THEN try_cast(trim(k) AS BIGINT) END AS stack_id, stack, digits::BIGINT AS weight
FROM (SELECT *, CASE WHEN q[1][1] = '"' THEN replace(q[1][2:-2], '""', '"') ELSE q[1] END AS p, CASE WHEN q[2][1] = '"' THEN replace(q[2][2:-2], '""', '"') ELSE q[2] END AS k FROM r)
WHERE reason IS NULL AND NOT (fmt = 'folded' AND kept = '')""",
    # a line of a file can state any weight of 64 bits
    "text_line_reasons": _PARSED.replace(
        "len(digits) > 16 OR try_cast(digits AS BIGINT) > 9007199254740991", "len(digits) > 20 OR try_cast(digits AS HUGEINT) > 18446744073709551615"
    )
    + """ SELECT CASE WHEN kept = '' THEN 'blank' ELSE coalesce(reason, 'valid') END AS reason, count(*) AS lines, coalesce(sum(try_cast(digits AS HUGEINT)) FILTER (reason IS NULL AND kept <> ''), 0)::VARCHAR AS weight
FROM r WHERE fmt = 'folded' GROUP BY 1""",
}
