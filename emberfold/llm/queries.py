"""Registered queries of this subpackage, and the SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .heavy_hitters import exact_figures, frequent_items, repeats_of
from ..storage import materialize
from .language import LANGUAGES, languages
from .leakage import leaked_items
from .packing import pack, token_counts
from .subsequences import frequent_paths

HITS = {"key": "hit_id", "item": "name", "weight": "self_weight", "share": 0.004, "epsilon": 0.0004}


def p1_patterns(spark: SparkSession, d: str) -> DataFrame:
    return frequent_paths(table(spark, d, "stack_records"), count_share=(3, 100), weight_share=(6, 100)).withColumn("steps", F.array_join("steps", ";"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    by_stacks = F.when(F.col("support") * 100 >= F.col("all_support") * 3, F.lit("stacks"))
    by_weight = F.when((F.col("weight") * 100 >= F.col("all_weight") * 6) & (F.col("weight") > 0), F.lit("weight"))
    return p1_patterns(spark, d).select("steps", F.explode(F.array_compact(F.array(by_stacks, by_weight))).alias("basis"))


def _candidates(hits: DataFrame) -> DataFrame:
    more = repeats_of(hits, **{k: HITS[k] for k in ("key", "item", "weight")})
    return exact_figures(hits, materialize(frequent_items(hits, **HITS, repeats=more)), **HITS, repeats=more)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    held = _candidates(table(spark, d, "frame_hits"))
    figure = F.when(F.col("basis") == "rows", F.col("rows")).otherwise(F.col("weight"))
    return held.where((figure * 1000 >= F.col("mass") * 4) & (figure > 0)).select(F.col("item").alias("name"), "basis")


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    return frequent_items(table(spark, d, "frame_hits"), **HITS)


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of each basis the whole mass, and the intervals of :func:`frequent_items` that don't hold the exact figure or are wider than they may be."""
    held = _candidates(table(spark, d, "frame_hits"))
    figure = F.when(F.col("basis") == "rows", F.col("rows")).otherwise(F.col("weight"))
    wide = F.col("high") - F.col("low") > 2 * HITS["epsilon"] * F.col("mass") + 1
    return held.groupBy("basis").agg(F.max("mass").alias("mass"), F.count_if((figure < F.col("low")) | (figure > F.col("high")) | wide).alias("outside"))


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("run_words >= 12").select("doc_id", "item_id", "run_words")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("run_words >= 12").select("doc_id", "item_id")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    sized = materialize(token_counts(table(spark, d, "documents")))
    return pack(sized).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of :func:`p6_pack`: the documents packed, containers above their capacity, documents whose pieces aren't their tokens or are
    more than need be, and whether the containers are within 1 % (and one) of the fewest that hold all tokens.
    """
    packed = materialize(p6_pack(spark, d))
    held = packed.where("size > 0").groupBy("container").agg(F.sum("size").alias("held")).agg(
        F.count_if(F.col("held") > 4096).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.sum("held").alias("tokens")
    )
    each = packed.groupBy("doc_id").agg(F.sum("size").alias("held"), F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    torn = (F.col("held") != F.col("tokens")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / 4096)))
    near = F.col("containers") <= F.ceil(F.col("tokens") / 4096) * 1.01 + 1
    return held.select(each.agg(F.count(F.lit(1))).scalar().alias("documents"), "overfull", each.agg(F.count_if(torn)).scalar().alias("torn"), near.alias("near_bound"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages(table(spark, d, "documents"))


def p8_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose label names a language, whether eight in ten of them are given that (about a tenth is labelled wrongly), and the texts that
    stand more than once and were given different languages.
    """
    docs = table(spark, d, "documents")
    found = materialize(p8_languages(spark, d).where("para_no = -1").select("doc_id", "lang", "label"))
    twice = docs.select("doc_id", F.xxhash64("text").alias("t")).join(found, "doc_id").groupBy("t").agg(F.count_distinct("lang").alias("n"))
    labelled = found.where("label is not null").agg(
        F.count(F.lit(1)).alias("labelled"), (F.count_if(F.col("lang") == F.col("label")) >= 0.8 * F.count(F.lit(1))).alias("agrees")
    )
    return labelled.withColumn("conflicts", twice.agg(F.count_if(F.col("n") > 1)).scalar())


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = (F.col("para_no") >= 0) | ~F.col("lang").eqNullSafe(F.col("label"))
    return p8_languages(spark, d).where(wrong & F.col("lang").isNotNull()).select("doc_id", "para_no", "lang").distinct()


QUERIES = {
    f.__name__: f for f in (p1_found, p1_patterns, p4_found, p4_intervals, p4_bounds, p6_pack, p6_fill, p7_found, p7_runs, p7_leaks, p8_found, p8_languages, p8_agreement)
}


def _growth_sql() -> str:
    """Prefix growth in SQL: for each stack and frequent pattern the place of its first completion, one item longer in each step."""
    often = "HAVING count(*) * 100 >= (SELECT n FROM t) * 3 OR sum(w) * 100 >= (SELECT w FROM t) * 6"
    steps = f"""WITH x AS (SELECT profile_id, frames, stack_id, max(weight) AS w FROM stack_records WHERE frames IS NOT NULL GROUP BY ALL),
s AS (SELECT row_number() OVER () AS sid, frames, w FROM (SELECT profile_id, frames, coalesce(sum(w), 0) AS w FROM x GROUP BY ALL)),
t AS (SELECT count(*) AS n, sum(w) AS w FROM s),
o AS (SELECT sid, w, unnest(frames) AS name, generate_subscripts(frames, 1) AS pos FROM s),
l1 AS (SELECT sid, w, name AS steps, min(pos) AS pos FROM o GROUP BY ALL),
k1 AS (SELECT steps FROM l1 GROUP BY steps {often}),
h AS (SELECT * FROM o WHERE name IN (SELECT steps FROM k1))"""
    for k in (2, 3, 4):
        steps += f""",
l{k} AS (SELECT l.sid, l.w, l.steps || ';' || h.name AS steps, min(h.pos) AS pos FROM l{k - 1} l JOIN k{k - 1} USING (steps) JOIN h ON h.sid = l.sid AND h.pos > l.pos GROUP BY ALL),
k{k} AS (SELECT steps, count(*) AS n, sum(w) AS w FROM l{k} GROUP BY steps {often})"""
    return steps + ", p AS (SELECT * FROM k3 UNION ALL SELECT * FROM k4)"


# Accents and commands of the markup, as the oracle reads them: letters lose their accents on both sides, which tells no passage of twelve words from another.
_WORDS_SQL = r"""regexp_extract_all(lower(strip_accents(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '\-', ''),
  '\{\s*\\[`''^~"=.]\s*\{?\s*\\?([[:alpha:]])\s*\}?\s*\}|\\[`''^~"=.]\s*(?:\{\s*\\?([[:alpha:]])\s*\}|\\?([[:alpha:]]))|\{?\\[uvHckrdb](?:\s*\{\s*\\?([[:alpha:]])\s*\}|\s+([[:alpha:]]))', '\1\2\3\4\5', 'g'),
  '\{\s*\\(ss|ae|oe|aa|o|l|i|j|AE|OE|AA|O|L)\s*\}|\\(ss|ae|oe|aa|o|l|i|j|AE|OE|AA|O|L)(?:\{\}|\b\s*)', '\1\2', 'g'),
  '\\[A-Za-z]*cite[A-Za-z]*\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}', ' ', 'g'), '-[ \t]*\r?\n[ \t%]*', '', 'g'), '\\(?:[A-Za-z@]+\*?|.)', ' ', 'g'), 'ß', 'ss', 'g')))), '[\p{L}\p{N}]+')"""

_RUNS_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT doc_id, a, hash(w[a:a + 11]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS a FROM d)),
e AS (SELECT item_id, b, hash(w[b:b + 11]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS b FROM i)),
m AS (SELECT DISTINCT doc_id, item_id, a, a - b AS shift FROM g JOIN e USING (h)),
r AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY a) AS island FROM m) GROUP BY doc_id, item_id, shift, island)"""

_HITS_SQL = "WITH h AS (SELECT DISTINCT hit_id, name, self_weight FROM frame_hits), t AS (SELECT count(*) AS n, sum(self_weight) AS w FROM h)"

ORACLES = {
    "p1_found": _growth_sql() + """ SELECT steps, 'stacks' AS basis FROM p, t WHERE p.n * 100 >= t.n * 3
UNION ALL SELECT steps, 'weight' AS basis FROM p, t WHERE p.w * 100 >= t.w * 6""",
    "p1_patterns": _growth_sql() + " SELECT steps, p.n AS support, p.w::BIGINT AS weight, t.n AS all_support, t.w::BIGINT AS all_weight FROM p, t",
    "p4_found": _HITS_SQL + """,
g AS (SELECT name, count(*) AS n, coalesce(sum(self_weight), 0) AS w FROM h WHERE name IS NOT NULL GROUP BY name)
SELECT name, 'rows' AS basis FROM g, t WHERE g.n * 1000 >= t.n * 4
UNION ALL SELECT name, 'weight' AS basis FROM g, t WHERE g.w * 1000 >= t.w * 4""",
    "p4_bounds": _HITS_SQL + " SELECT 'rows' AS basis, n::BIGINT AS mass, 0::BIGINT AS outside FROM t UNION ALL SELECT 'weight', w::BIGINT, 0::BIGINT FROM t",
    "p6_fill": "SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS torn, true AS near_bound FROM documents",
    "p7_found": _RUNS_SQL + " SELECT DISTINCT doc_id, item_id FROM r",
    "p7_runs": _RUNS_SQL + " SELECT doc_id, item_id, max(n) AS run_words FROM r GROUP BY ALL",
    "p8_agreement": f"""SELECT count(*) AS labelled, true AS agrees, 0::BIGINT AS conflicts FROM documents
WHERE regexp_extract(lower(trim(lang)), '^([^-_]*)', 1) IN ({', '.join(f"'{x}'" for names in LANGUAGES.values() for x in names.split())})""",
}
