"""Registered queries over profiles, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import tree as T
from ..operators.badrows import with_errors
from ..operators.catalog import checked_entries
from ..operators.paths import FrameWindow, paths, selected_paths
from ..sources.profiles import different_records, events, recorded, recorded_by_profile, star, valid_records
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPLIT_DAY = "2024-01-16"
_EVENTS = "SELECT list(event_type ORDER BY ts, event_id) AS frames FROM events WHERE {when} GROUP BY user_id, date_trunc('day', ts)"
BASES = {
    "star": """SELECT frames, sum(w)::BIGINT AS weight FROM (SELECT [r_name, n_name, c_mktsegment, o_orderpriority, l_returnflag] AS frames, l_quantity::BIGINT AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY frames""",
    "events": f"SELECT frames, count(*)::BIGINT AS weight FROM ({_EVENTS.format(when='true')}) GROUP BY frames",
    "recorded": "SELECT frames, sum(weight)::BIGINT AS weight FROM (SELECT DISTINCT profile_id, stack_id, frames, weight FROM stack_records WHERE frames IS NOT NULL AND len(frames) > 0 AND weight >= 1) GROUP BY frames",
    "early": f"SELECT frames, count(*)::BIGINT AS weight FROM ({_EVENTS.format(when=f"ts < TIMESTAMP '{SPLIT_DAY}'")}) GROUP BY frames",
    "late": f"SELECT frames, count(*)::BIGINT AS weight FROM ({_EVENTS.format(when=f"ts >= TIMESTAMP '{SPLIT_DAY}'")}) GROUP BY frames",
}
SOURCES: dict[str, Query] = {
    "star": star,
    "events": events,
    "recorded": recorded,
    "early": lambda s, d: events(s, d, f"ts < timestamp '{SPLIT_DAY}'"),
    "late": lambda s, d: events(s, d, f"ts >= timestamp '{SPLIT_DAY}'"),
}


def add(name: str, base: str, make: Callable[[DataFrame], DataFrame], sql: str | None, more: str = "") -> None:
    QUERIES[name] = lambda s, d: make(SOURCES[base](s, d))
    if sql is not None:
        ORACLES[name] = f"WITH s AS ({BASES[base]}), t AS (SELECT coalesce(sum(weight), 0)::BIGINT AS total FROM s){more} {sql}"


def stats_sql(source: str, name: str = "st") -> str:
    """A further table of the SQL: statistics of each frame of ``source``."""
    return f""", {name}_l AS (SELECT frames[-1] AS name, sum(weight) AS w FROM {source} GROUP BY 1),
{name}_i AS (SELECT name, sum(weight) AS w, count(*) AS n FROM (SELECT unnest(list_distinct(frames)) AS name, weight FROM {source}) GROUP BY 1),
{name} AS (SELECT i.name, coalesce(l.w, 0)::BIGINT AS self_weight, i.w::BIGINT AS inclusive_weight, i.n::BIGINT AS stack_count FROM {name}_i i LEFT JOIN {name}_l l USING (name))"""


def pct(weight: str, scope: str) -> str:
    return f"CASE WHEN {scope} = 0 THEN 0.0 ELSE {weight}::DOUBLE * 100.0 / {scope}::DOUBLE END"


def _joined(df: DataFrame, *names: str) -> DataFrame:
    for c in names:
        df = df.withColumn(c, F.array_join(c, ";"))
    return df


def _numbers(df: DataFrame, *names: str) -> DataFrame:
    for c in names:
        df = df.withColumn(c, F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return df


# The parser, over the text of all derived stacks and over the raw lines


def _round_trip(stacks: DataFrame) -> DataFrame:
    lines = stacks.select(F.lit("folded").alias("fmt"), F.concat(F.array_join("frames", ";"), F.lit(" "), F.col("weight").cast("string"), F.lit(" \t\r")).alias("line"))
    return with_errors(lines).select(F.array_join("__frames", ";").alias("stack"), F.col("__weight").alias("weight"), F.size("__errors").cast("bigint").alias("errors"))


for _b in ("star", "recorded"):
    # a blank at the end of the last frame belongs to the separator
    add(f"parse_folded_{_b}", _b, _round_trip, "SELECT rtrim(array_to_string(frames, ';')) AS stack, weight, 0::BIGINT AS errors FROM s")
for _b in ("star", "events", "recorded"):
    add(f"unique_stacks_{_b}", _b, lambda s: _joined(s, "frames"), "SELECT array_to_string(frames, ';') AS frames, weight FROM s")
    add(
        f"summary_totals_{_b}",
        _b,
        lambda s: P.totals(s).withColumns(
            {"frame_count": P.frame_stats(s).agg(F.count(F.lit(1))).scalar(), "unknown_frame_weight": P.weight_of(P.containing(s, P.UNKNOWN))}
        ),
        "SELECT total AS total_weight, (SELECT count(*) FROM s) AS unique_stack_count, (SELECT coalesce(max(len(frames)), 0)::BIGINT FROM s) AS max_depth, (SELECT count(*) FROM st) AS frame_count, (SELECT coalesce(sum(inclusive_weight) FILTER (name = '[unknown]'), 0)::BIGINT FROM st) AS unknown_frame_weight FROM t",
        stats_sql("s"),
    )
    add(f"frame_stats_{_b}", _b, P.frame_stats, "SELECT * FROM st", stats_sql("s"))
    add(
        f"frame_ids_{_b}",
        _b,
        P.frame_ids,
        "SELECT row_number() OVER (ORDER BY seen) - 1 AS frame_id, name FROM (SELECT name, min({'l': frames, 'p': pos}) AS seen FROM (SELECT frames, unnest(frames) AS name, generate_subscripts(frames, 1) AS pos FROM s) GROUP BY name)",
    )

# Rankings


def _top_sql(metric: str, limit: int, scope: str = "(SELECT coalesce(sum(weight), 0)::BIGINT AS scope FROM s)", where: str = "true") -> str:
    return f"""SELECT row_number() OVER (ORDER BY {metric} DESC, self_weight DESC, name) AS rank, name, self_weight, inclusive_weight, stack_count,
{pct(metric, 'total')} AS profile_percent, {pct(metric, 'scope')} AS scope_percent FROM st, t, {scope} WHERE {where} QUALIFY rank <= {limit}"""


FOCUS = {"star": "ASIA", "events": "error", "recorded": "interp::eval_list"}
REGEX = {"star": "^[A-Z]+$", "events": "r", "recorded": r"::[a-z]+_"}
PART = {"star": "A", "events": "e", "recorded": "::"}
for _b in ("star", "events", "recorded"):
    _f, _r, _p = FOCUS[_b], REGEX[_b], PART[_b]
    _scoped = f", sc AS (SELECT * FROM s WHERE list_contains(frames, '{_f}'))"
    _scope = "(SELECT coalesce(sum(weight), 0)::BIGINT AS scope FROM sc)"
    add(f"top_self_{_b}", _b, lambda s: P.top(s), _top_sql("self_weight", 20), stats_sql("s"))
    add(f"top_inclusive_{_b}", _b, lambda s: P.top(s, "inclusive_weight", 200), _top_sql("inclusive_weight", 200), stats_sql("s"))
    add(f"top_focus_{_b}", _b, lambda s, f=_f: P.top(s, "inclusive_weight", 50, focus=f), _top_sql("inclusive_weight", 50, _scope), _scoped + stats_sql("sc"))
    add(
        f"top_regex_{_b}", _b, lambda s, r=_r: P.top(s, "self_weight", 20, name_regex=f"(?dU){r}"),
        _top_sql("self_weight", 20, where=f"regexp_matches(name, '{_r}')"), stats_sql("s")
    )
    add(f"find_contains_{_b}", _b, lambda s, p=_p: P.find(s, p, limit=100), _top_sql("inclusive_weight", 100, where=f"contains(name, '{_p}')"), stats_sql("s"))
    add(f"find_regex_{_b}", _b, lambda s, r=_r: P.find(s, f"(?dU){r}", "regex"), _top_sql("inclusive_weight", 20, where=f"regexp_matches(name, '{_r}')"), stats_sql("s"))
    add(
        f"symbol_context_{_b}",
        _b,
        P.symbol_context,
        """, p AS (SELECT weight, unnest(list_distinct([{'up': frames[i], 'down': frames[i + 1]} for i in range(1, len(frames))])) AS e FROM s WHERE len(frames) > 1),
g AS (SELECT e.up AS up, e.down AS down, sum(weight)::BIGINT AS weight FROM p GROUP BY ALL),
b AS (SELECT down AS name, 'caller' AS side, up AS other, weight FROM g UNION ALL SELECT up, 'callee', down, weight FROM g)
SELECT name, side, other, weight, row_number() OVER (PARTITION BY name, side ORDER BY weight DESC, other) AS rank FROM b QUALIFY rank <= 3""",
    )

_IDS = "(SELECT row_number() OVER (ORDER BY seen) - 1 AS frame_id, name FROM (SELECT name, min({'l': frames, 'p': pos}) AS seen FROM (SELECT frames, unnest(frames) AS name, generate_subscripts(frames, 1) AS pos FROM s) GROUP BY name))"


def _limits(stacks: DataFrame, part: str) -> DataFrame:
    """How many rows a search and a ranking leave out at a limit of 20."""
    stats = P.frame_stats(stacks)
    found = stats.where(F.contains("name", F.lit(part)))
    shown = P.find(stacks, part, limit=20).agg(F.count(F.lit(1)).alias("returned"))
    return shown.withColumn("available", found.agg(F.count(F.lit(1))).scalar()).select("returned", "available", (F.col("available") - F.col("returned")).alias("omitted"))


for _b in ("star", "events", "recorded"):
    add(
        f"row_limits_{_b}",
        _b,
        lambda s, p=PART[_b]: _limits(s, p),
        f"SELECT least(n, 20) AS returned, n AS available, n - least(n, 20) AS omitted FROM (SELECT count(*) AS n FROM st WHERE contains(name, '{PART[_b]}'))",
        stats_sql("s"),
    )
    add(f"frame_rows_{_b}", _b, lambda s: P.frame_ids(s).join(P.frame_stats(s), "name"), f"SELECT i.frame_id, st.* FROM st JOIN {_IDS} i USING (name)", stats_sql("s"))
    add(
        f"stack_fingerprints_{_b}",
        _b,
        lambda s: s.select(F.sha2(F.concat(F.array_join("frames", ";"), F.lit(" "), F.col("weight").cast("string")), 256).alias("fingerprint")),
        "SELECT sha256(array_to_string(frames, ';') || ' ' || weight) AS fingerprint FROM s",
    )

# The tree


def nodes_sql(source: str, levels: int | None = None) -> str:
    last = "len(frames)" if levels is None else f"least(len(frames), {levels})"
    return f"""SELECT path, len(path)::BIGINT AS depth, coalesce(sum(weight) FILTER (len(path) = n), 0)::BIGINT AS self_weight, sum(weight)::BIGINT AS total_weight
FROM (SELECT frames[1:d] AS path, weight, len(frames) AS n FROM (SELECT *, unnest(range(0, {last} + 1)) AS d FROM {source})) GROUP BY path"""


def page_sql(source: str, levels: int, most: int, least: float) -> str:
    """Further tables of the SQL: the nodes ``n``, the rendered ones ``r`` with their keys, and the omitted children ``o``."""
    return f""", n0 AS ({nodes_sql(source, levels + 1)}), n AS (SELECT n0.*, {pct('total_weight', 'scope')} AS scope_percent FROM n0, (SELECT total_weight AS scope FROM n0 WHERE depth = 0)),
c AS (SELECT * FROM n WHERE depth <= {levels} AND (depth = 0 OR scope_percent >= {least})),
k AS (SELECT c.path, list({{'t': -u.total_weight, 'name': u.path[-1]}} ORDER BY u.depth) AS key FROM (SELECT path, unnest([path[1:i] for i in range(1, len(path) + 1)]) AS up FROM c) c JOIN n u ON u.path = c.up GROUP BY c.path
  UNION ALL SELECT path, [] AS key FROM c WHERE depth = 0),
r AS (SELECT c.*, k.key, row_number() OVER (ORDER BY k.key) AS rank FROM c JOIN k USING (path) QUALIFY rank <= {most}),
o AS (SELECT x.path, x.depth, x.total_weight, x.scope_percent, CASE WHEN x.depth > {levels} THEN 'depth_limit' WHEN x.scope_percent < {least} THEN 'min_scope_percent' ELSE 'node_budget' END AS reason,
  list_append(r.key, {{'t': -x.total_weight, 'name': x.path[-1]}}) AS key FROM n x JOIN r ON r.path = x.path[1:len(x.path) - 1] AND x.depth > 0 ANTI JOIN r r2 ON r2.path = x.path)"""


_SHOWN = "SELECT rank, array_to_string(path, ';') AS path, depth, self_weight, total_weight, scope_percent FROM r"
PAGES = {"star": (4, 64, 0.1), "events": (5, 64, 0.1), "recorded": (8, 200, 0.05)}
for _b, (_d, _n, _m) in PAGES.items():
    _page = page_sql("s", _d, _n, _m)
    add(
        f"cct_nodes_{_b}", _b, lambda s: _joined(T.nodes(s), "path"),
        f"SELECT array_to_string(path, ';') AS path, depth, self_weight, total_weight FROM ({nodes_sql('s')})"
    )
    add(f"tree_page_{_b}", _b, lambda s, d=_d, n=_n, m=_m: _joined(T.tree_page(s, None, d, n, m)[0], "path"), _SHOWN, _page)
    add(
        f"tree_omitted_{_b}", _b, lambda s, d=_d, n=_n, m=_m: T.omitted_by_reason(T.tree_page(s, None, d, n, m)[1]),
        "SELECT reason, count(*) AS children, sum(total_weight)::BIGINT AS weight FROM o GROUP BY reason", _page
    )
    add(
        f"tree_continuations_{_b}",
        _b,
        lambda s, d=_d, n=_n, m=_m: _joined(T.continuations(T.tree_page(s, None, d, n, m)[1]), "path"),
        "SELECT array_to_string(path, ';') AS path, depth, total_weight, scope_percent, reason, row_number() OVER (ORDER BY key) AS rank FROM o QUALIFY rank <= 128",
        _page,
    )
    _up = f", ch AS (SELECT rv[list_position(rv, '{FOCUS[_b]}') + 1:] AS frames, sum(weight)::BIGINT AS weight FROM (SELECT list_reverse(frames) AS rv, weight FROM s WHERE list_contains(frames, '{FOCUS[_b]}')) GROUP BY 1)"
    _down = f", ch AS (SELECT frames[list_position(frames, '{FOCUS[_b]}') + 1:] AS frames, sum(weight)::BIGINT AS weight FROM s WHERE list_contains(frames, '{FOCUS[_b]}') GROUP BY 1)"
    for _name, _rest, _upward in (("callers", _up, True), ("callees", _down, False)):
        add(
            f"{_name}_tree_{_b}", _b, lambda s, d=_d, n=_n, m=_m, f=FOCUS[_b],
            u=_upward: _joined(T.tree_page(T.chains(s, f, u), None, d, n, m)[0], "path"), _SHOWN, _rest + page_sql("ch", _d, _n, _m)
        )

for _b in ("star", "events", "recorded"):
    add(
        f"cct_node_ids_{_b}",
        _b,
        lambda s: T.node_ids(s, P.frame_ids(s)),
        f"""SELECT row_number() OVER (ORDER BY ids) - 1 AS node_id, array_to_string(path, ';') AS path, self_weight, total_weight
FROM (SELECT n.*, [m[x] for x in n.path] AS ids FROM n, (SELECT map(list(name), list(frame_id)) AS m FROM i) mm)""",
        f""", i AS (SELECT row_number() OVER (ORDER BY seen) - 1 AS frame_id, name FROM (SELECT name, min({{'l': frames, 'p': pos}}) AS seen FROM (SELECT frames, unnest(frames) AS name, generate_subscripts(frames, 1) AS pos FROM s) GROUP BY name)),
n AS ({nodes_sql('s')})""",
    )

    add(
        f"stack_ids_{_b}",
        _b,
        lambda s: _joined(T.stack_ids(s, P.frame_ids(s)), "frames"),
        """SELECT row_number() OVER (ORDER BY ids) - 1 AS stack_id, array_to_string(frames, ';') AS frames, weight
FROM (SELECT s.*, [m[x] for x in s.frames] AS ids FROM s, (SELECT map(list(name), list(frame_id)) AS m FROM i) mm)""",
        """, i AS (SELECT row_number() OVER (ORDER BY seen) - 1 AS frame_id, name FROM (SELECT name, min({'l': frames, 'p': pos}) AS seen FROM (SELECT frames, unnest(frames) AS name, generate_subscripts(frames, 1) AS pos FROM s) GROUP BY name))""",
    )

# repeated records change no first place of a name, and equal stacks are summed with their nodes, so no stack is grouped before it is a key
QUERIES["cct_node_ids_recorded"] = lambda s, d: T.node_ids(different_records(s, d), P.frame_ids(valid_records(s, d)))

for _b, _root in (("star", ["ASIA"]), ("events", ["view", "click"]), ("recorded", ["boot_main"])):
    _d, _n, _m = PAGES[_b]
    _below = f", ch AS (SELECT frames[{len(_root) + 1}:] AS frames, sum(weight)::BIGINT AS weight FROM s WHERE frames[1:{len(_root)}] = {_root!r} GROUP BY 1)"
    add(f"tree_below_{_b}", _b, lambda s, r=_root, d=_d, n=_n, m=_m: _joined(T.tree_page(s, r, d, n, m)[0], "path"), _SHOWN, _below + page_sql("ch", _d, _n, _m))

# Paths


def _path_rows(df: DataFrame) -> DataFrame:
    return _numbers(_joined(df, "frames"), "target_positions", "display_target_positions")


def paths_sql(focus: str, limit: int, budget: int, lo: str, hi: str, crop: str) -> str:
    return f""", sel AS (SELECT frames, weight, row_number() OVER (ORDER BY weight DESC, frames) AS rank, len(frames) AS n, [i - 1 for i in range(1, len(frames) + 1) if frames[i] = '{focus}'] AS pos
  FROM s WHERE list_contains(frames, '{focus}') QUALIFY rank <= {limit}),
w AS (SELECT *, {lo} AS lo, {hi} AS hi FROM sel),
b AS (SELECT *, hi - lo AS req, greatest({budget} - coalesce(sum(hi - lo) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS available FROM w),
l AS (SELECT *, least(req, available) AS got FROM b WHERE available > 0),
f AS (SELECT *, CASE WHEN got = req THEN lo ELSE {crop} END AS a FROM l), sc AS (SELECT sum(weight)::BIGINT AS scope FROM s WHERE list_contains(frames, '{focus}'))
SELECT rank, array_to_string(frames[a + 1:a + got], ';') AS frames, weight, {pct('weight', 'total')} AS profile_percent, {pct('weight', 'scope')} AS scope_percent, array_to_string(pos, ',') AS target_positions,
array_to_string([p - a for p in pos if p >= a and p < a + got], ',') AS display_target_positions, n::BIGINT AS total_depth, lo::BIGINT AS requested_start, hi::BIGINT AS requested_end, a::BIGINT AS frame_start, (a + got)::BIGINT AS frame_end,
a::BIGINT AS omitted_before, (n - a - got)::BIGINT AS omitted_after, (a - lo)::BIGINT AS budget_omitted_before, (hi - a - got)::BIGINT AS budget_omitted_after FROM f, t, sc"""


_MIDDLE = "greatest(lo, least(pos[1] - got // 2, hi - got))"
WINDOWS = {
    "full": (None, 500, "0", "n", _MIDDLE),
    "head": (FrameWindow("head", lines=4), 500, "0", "least(n, 4)", "lo"),
    "tail": (FrameWindow("tail", lines=4), 30, "greatest(n - 4, 0)", "n", "hi - got"),
    "around": (FrameWindow("around_target", before=2, after=1), 40, "greatest(pos[1] - 2, 0)", "least(n, pos[-1] + 2)", _MIDDLE),
    "budget": (None, 37, "0", "n", _MIDDLE),
}
for _b in ("star", "events", "recorded"):
    for _w, (_win, _budget, _lo, _hi, _crop) in WINDOWS.items():
        add(
            f"paths_{_w}_{_b}",
            _b,
            lambda s, f=FOCUS[_b], w=_win, n=_budget: _path_rows(paths(s, f, limit=20, window=w, max_total_frames=n)),
            paths_sql(FOCUS[_b], 20, _budget, _lo, _hi, _crop).removeprefix(","),
            ",",
        )


def _budget(stacks: DataFrame) -> DataFrame:
    rows = selected_paths(stacks, FOCUS["recorded"], limit=20, max_total_frames=100)
    got = F.col("frame_end") - F.col("frame_start")
    req = F.col("requested_end") - F.col("requested_start")
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(
        one(req).alias("available"), one(got).alias("returned"), one(req - got).alias("omitted"), F.count(F.lit(1)).alias("selected_paths"),
        F.count_if(F.col("available") > 0).alias("returned_paths"), F.count_if((F.col("available") > 0) & (got < req)).alias("cropped_paths")
    )


add(
    "paths_budget_totals_recorded",
    "recorded",
    _budget,
    """SELECT sum(n)::BIGINT AS available, sum(got)::BIGINT AS returned, sum(n - got)::BIGINT AS omitted, count(*) AS selected_paths, count(*) FILTER (left_ > 0) AS returned_paths, count(*) FILTER (left_ > 0 AND got < n) AS cropped_paths
FROM (SELECT n, left_, least(n, left_) AS got FROM (SELECT n, greatest(100 - coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS left_ FROM sel))""",
    f", sel AS (SELECT len(frames) AS n, row_number() OVER (ORDER BY weight DESC, frames) AS rank FROM s WHERE list_contains(frames, '{FOCUS['recorded']}') QUALIFY rank <= 20)",
)

def _cropped(stacks: DataFrame) -> DataFrame:
    rows = selected_paths(stacks, FOCUS["recorded"], limit=20, window=FrameWindow("around_target", before=2, after=1))
    cropped = rows.where((F.col("requested_start") > 0) | (F.col("requested_end") < F.col("total_depth")))
    return cropped.agg(
        F.count(F.lit(1)).alias("cropped_paths"),
        F.coalesce(F.sum("requested_start"), F.lit(0)).alias("omitted_before"),
        F.coalesce(F.sum(F.col("total_depth") - F.col("requested_end")), F.lit(0)).alias("omitted_after"),
    )


add(
    "paths_window_totals_recorded",
    "recorded",
    _cropped,
    """SELECT count(*) AS cropped_paths, coalesce(sum(lo), 0)::BIGINT AS omitted_before, coalesce(sum(n - hi), 0)::BIGINT AS omitted_after
FROM (SELECT n, greatest(pos[1] - 2, 0) AS lo, least(n, pos[-1] + 2) AS hi FROM sel) WHERE lo > 0 OR hi < n""",
    f""", sel AS (SELECT len(frames) AS n, [i - 1 for i in range(1, len(frames) + 1) if frames[i] = '{FOCUS['recorded']}'] AS pos, row_number() OVER (ORDER BY weight DESC, frames) AS rank
FROM s WHERE list_contains(frames, '{FOCUS['recorded']}') QUALIFY rank <= 20)""",
)

# Comparison of two profiles


def _diff(name: str, sort: str, metric: str, limit: int, regex: str | None = None) -> None:
    QUERIES[name] = lambda s, d: P.diff(SOURCES["early"](s, d), SOURCES["late"](s, d), metric, sort, limit, None if regex is None else f"(?dU){regex}")
    order = {"regression": "delta_pp DESC", "improvement": "delta_pp", "absolute": "abs(delta_pp) DESC"}[sort]
    where = "true" if regex is None else f"regexp_matches(name, '{regex}')"
    ORACLES[name] = f"""WITH s AS ({BASES['early']}), s2 AS ({BASES['late']}){stats_sql('s', 'a')}{stats_sql('s2', 'b')},
j AS (SELECT name, coalesce(a.{metric}, 0) AS baseline_weight, coalesce(b.{metric}, 0) AS candidate_weight FROM a FULL JOIN b USING (name)),
p AS (SELECT j.*, {pct('baseline_weight', 'x')} AS baseline_percent, {pct('candidate_weight', 'y')} AS candidate_percent FROM j, (SELECT sum(weight)::BIGINT AS x FROM s), (SELECT sum(weight)::BIGINT AS y FROM s2)),
q AS (SELECT *, candidate_percent - baseline_percent AS delta_pp FROM p WHERE {where})
SELECT *, row_number() OVER (ORDER BY {order}, name) AS rank FROM q QUALIFY rank <= {limit}"""


_diff("diff_regression", "regression", "self_weight", 30)
_diff("diff_improvement", "improvement", "inclusive_weight", 30)
_diff("diff_absolute", "absolute", "self_weight", 3)
_diff("diff_regex", "regression", "inclusive_weight", 30, "e")

# Every profile at once


def frame_stats_by_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.frame_stats(recorded_by_profile(spark, d), "profile_id")


def latest_registrations(spark: SparkSession, d: str) -> DataFrame:
    """Of each alias the registration that holds, i.e. the latest; a null alias names none."""
    rows = table(spark, d, "profiles").where("alias is not null")
    last = rows.groupBy("alias").agg(F.max(F.struct("registered_unix_ms", "profile_id", "fingerprint", "byte_len")).alias("r"), F.count(F.lit(1)).alias("registrations"))
    return last.select("alias", "r.registered_unix_ms", "r.profile_id", "r.fingerprint", "r.byte_len", "registrations")


def catalog_entries(spark: SparkSession, d: str) -> DataFrame:
    return checked_entries(table(spark, d, "profiles"))


QUERIES |= {"catalog_entries": catalog_entries, "frame_stats_by_profile": frame_stats_by_profile, "latest_registrations": latest_registrations}
ORACLES |= {
    "catalog_entries": r"""SELECT profile_id, coalesce(regexp_full_match(alias, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}'), false) AS alias_ok,
CASE WHEN regexp_full_match(stem, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') THEN stem ELSE 'default' END AS default_alias, coalesce(regexp_full_match(fingerprint, '[0-9a-f]{64}'), false) AS fingerprint_ok,
strftime(make_timestamp(registered_unix_ms * 1000), '%Y-%m-%d') AS day, to_json({'alias': alias, 'source_name': source_name, 'fingerprint': fingerprint, 'byte_len': byte_len, 'registered_unix_ms': registered_unix_ms})::VARCHAR AS entry
FROM (SELECT *, regexp_replace(source_name, '(.)[.][^.]*$', '\1') AS stem FROM profiles)""",
    "frame_stats_by_profile": """WITH s AS (SELECT profile_id, frames, sum(weight)::BIGINT AS weight FROM (SELECT DISTINCT profile_id, stack_id, frames, weight FROM stack_records WHERE frames IS NOT NULL AND len(frames) > 0 AND weight >= 1) GROUP BY ALL)
SELECT profile_id, name, coalesce(sum(weight) FILTER (name = leaf), 0)::BIGINT AS self_weight, sum(weight)::BIGINT AS inclusive_weight, count(*) AS stack_count
FROM (SELECT profile_id, weight, frames[-1] AS leaf, unnest(list_distinct(frames)) AS name FROM s) GROUP BY profile_id, name""",
    "latest_registrations": """SELECT alias, registered_unix_ms, profile_id, fingerprint, byte_len, registrations FROM (SELECT *, count(*) OVER (PARTITION BY alias) AS registrations,
row_number() OVER (PARTITION BY alias ORDER BY registered_unix_ms DESC, profile_id DESC) AS r FROM profiles WHERE alias IS NOT NULL) WHERE r = 1""",
}
