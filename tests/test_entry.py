"""The registered queries against their SQL, and properties of random profiles."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from emberfold.operators import profile as P
from emberfold.operators import tree as T
from emberfold.storage import shared_dir

FOLDER = "/root/testdata/sf0.001"
CORE = [n for n in entry.oracle_sql() if not (n[0] == "p" and n[1].isdigit() and n[1] not in "235")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def told(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
@pytest.mark.parametrize("name", [n for n in CORE if not n.endswith(("_star", "_events"))])
def test_against_sql(spark, duck, name):
    df, want = entry.queries()[name](spark, FOLDER), duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(told, r)) for r in df.collect()) == Counter(tuple(told(r[i]) for i in at) for r in want.fetchall())


def walk(stacks, levels, most, least):
    """The budgeted walk, one node after the other."""
    total = Counter()
    for f, w in stacks.items():
        for d in range(len(f) + 1):
            total[f[:d]] += w
    scope, shown, left = total[()], [], []

    def go(path):
        shown.append(path)
        for c in sorted((p for p in total if len(p) == len(path) + 1 and p[: len(path)] == path), key=lambda p: (-total[p], p[-1])):
            why = "depth_limit" if len(path) >= levels else "min_scope_percent" if total[c] * 100.0 / scope < least else "node_budget" if len(shown) >= most else None
            if why is None:
                go(c)
            else:
                left.append((c, why))

    go(())
    return shown, left


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.lists(st.sampled_from("abc"), min_size=1, max_size=5).map(tuple), st.integers(1, 20), min_size=1, max_size=12), st.integers(0, 4), st.integers(1, 8), st.sampled_from([0.0, 10.0, 30.0]))
def test_pages(spark, stacks, levels, most, least):
    df = spark.createDataFrame([(list(f), w) for f, w in stacks.items()], "frames array<string>, weight bigint")
    shown, omitted = T.tree_page(df, None, levels, most, least)
    rows = [tuple(r["path"]) for r in shown.orderBy("rank").collect()]
    left = [(tuple(r["path"]), r["reason"]) for r in T.continuations(omitted).orderBy("rank").collect()]
    assert (rows, left) == walk(stacks, levels, most, least)
    stats = P.frame_stats(df).collect()
    assert sum(r["self_weight"] for r in stats) == sum(stacks.values()) and all(r["self_weight"] <= r["inclusive_weight"] for r in stats)


def test_ids_of_many_names_and_deep_stacks(spark, monkeypatch):
    """Also where names are too many to be sent, and with a stack of the largest depth."""
    deep = [f"f{i % 3}" for i in range(4096)]
    df = spark.createDataFrame([(["a", "b"], 1), (["a"], 2), (["b", "a"], 3), (deep, 5)], "frames array<string>, weight bigint")
    want = [tuple(r) for r in T.node_ids(df, P.frame_ids(df)).orderBy("node_id").select("path", "total_weight").collect()]
    assert len(want) == 4096 + 5 and want[0] == ("", 11) and want[1] == ("a", 3)
    monkeypatch.setattr("emberfold.operators.tree.MOST_NAMES_SENT", 0)
    assert [tuple(r) for r in T.node_ids(df, P.frame_ids(df)).orderBy("node_id").select("path", "total_weight").collect()] == want
    assert [r["weight"] for r in T.stack_ids(df, P.frame_ids(df)).orderBy("stack_id").collect()] == [2, 1, 3, 5]
    assert T.nodes(df.limit(0)).count() == P.frame_ids(df.limit(0)).count() == 0
    shown, omitted = T.tree_page(df.limit(0))
    assert shown.count() == omitted.count() == 0


def numbered_walk(stacks):
    """The tree's nodes in the order of the ids that names get by first appearance in sorted stacks, and what they hold."""
    seen, own, total = {}, Counter(), Counter()
    for f in sorted(stacks, key=lambda f: [x.encode() for x in f]):
        for x in f:
            seen.setdefault(x, len(seen))
        own[f] += stacks[f]
        for d in range(len(f) + 1):
            total[f[:d]] += stacks[f]
    return [(i, ";".join(p), own[p], total[p]) for i, p in enumerate(sorted(total, key=lambda p: [seen[x] for x in p]))]


@pytest.mark.parametrize("held", ["emberfold.operators.numbering.MOST_BYTES_SENT", None])
@pytest.mark.parametrize("seed,alphabet,n", [(1, "ab", 300), (2, "nmlkjihgfedcba", 60), (3, "aé€bßq", 120), (4, "zyx", 1)])
def test_ids_over_several_ranges_and_batches(spark, monkeypatch, seed, alphabet, n, held):
    """Nodes that are open where a batch or a range ends get the weight of what follows; names of many bytes aren't sent; equal stacks are summed."""
    rng = random.Random(seed)
    rows = [([rng.choice(alphabet) * rng.randrange(1, 3) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 9)) for _ in range(n)]
    stacks = Counter()
    for f, w in rows:
        stacks[tuple(f)] += w
    if held:
        monkeypatch.setattr(held, 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "frames array<string>, weight bigint")
        got = T.node_ids(df, P.frame_ids(df)).select("node_id", "path", "self_weight", "total_weight").orderBy("node_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in got] == numbered_walk(stacks)


def test_ids_hold_no_paths(spark):
    """What is kept to number the nodes is linear in the stacks, however long the paths are."""
    folder = shared_dir(spark).removeprefix("file:")
    kept = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    df = spark.createDataFrame([([f"{i % 7}{d}".rjust(60, "x") for d in range(300)], 1) for i in range(7)], "frames array<string>, weight bigint")
    before = kept()
    nodes = T.node_ids(df, P.frame_ids(df))
    assert nodes.count() == 7 * 300 + 1 and kept() - before < 2_000_000
