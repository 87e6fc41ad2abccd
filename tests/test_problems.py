"""The core's data problems on small tables, with nulls, ties, repeated and empty ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfold.operators.badrows import failed_records, valid_records
from emberfold.operators.catalog import checked_entries
from emberfold.operators.difference import CHECKS, FIRST_ELEMENT, P, characteristic, horner, reconcile, table_difference
from emberfold.operators.repeats import repeated
from emberfold.operators.skewed import counts_that_disagree, stacks_per_frame

ROW = "profile_id bigint, frame_id int, name string, self_weight bigint, inclusive_weight bigint, field string, side double"


def sketch(x, points):
    return characteristic(np.array(x, dtype=np.uint64), np.array([0]), points) if x else np.ones((1, points), np.uint64)


@pytest.mark.parametrize("own_a, own_b, common", [(0, 0, 5), (3, 0, 5), (0, 4, 0), (5, 5, 90), (1, 1, 0), (15, 0, 3), (0, 32, 7), (9, 4, 2000)])
def test_reconciliation(own_a, own_b, common):
    rng = random.Random(own_a * 31 + own_b)
    shared, a, b = ([rng.randrange(FIRST_ELEMENT, P) for _ in range(n)] for n in (common, own_a, own_b))
    n_a, n_b = np.array([common + own_a]), np.array([common + own_b])
    for bound in (2, 4, 8, 16, 32):
        solved, num, den, only_a, only_b = reconcile(n_a, n_b, sketch(shared + a, bound + CHECKS), sketch(shared + b, bound + CHECKS), bound)
        assert solved[0] == (own_a + own_b <= bound)
        if solved[0]:
            assert (only_a[0], only_b[0]) == (own_a, own_b)
            for poly, own, all_ in ((num, a, shared + a), (den, b, shared + b)):
                assert [x for x in all_ if horner(poly, np.uint64(x))[0] == 0] == own


def exact(base, copy):
    a, b = {}, {}
    for rows, to in ((base, a), (copy, b)):
        for r in rows:
            to.setdefault(r[:2], set()).add(r[2:5])
    out = {(*k, "missing_in_copy") for k in a.keys() - b.keys()} | {(*k, "missing_in_base") for k in b.keys() - a.keys()}
    return out | {(*k, f) for k in a.keys() & b.keys() for i, f in enumerate(("name", "self_weight", "inclusive_weight")) if {v[i] for v in a[k]} != {v[i] for v in b[k]}}


@pytest.mark.parametrize("seed, n, changed", [(1, 300, 0.1), (2, 200, 1.0), (3, 5, 0.5), (4, 0, 0.5)])
def test_difference(spark, seed, n, changed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, *range(4)])
    row = lambda k: (*k, rng.choice([None, "", "a", "A", "a "]), pick(), pick(), "x", 1.0)
    keys = [(rng.choice([None, *range(20)]), rng.choice([None, *range(50)])) for _ in range(n)]
    base = [row(k) for k in keys] * 2
    copy = [r if rng.random() > changed else rng.choice([row(r[:2]), row((99, rng.randrange(50)))]) for r in base[:n] if rng.random() > 0.05]
    rng.shuffle(copy)
    got = table_difference(spark.createDataFrame(base, ROW), spark.createDataFrame(copy, ROW), ["profile_id", "frame_id"], ["name", "self_weight", "inclusive_weight"], bucket_rows=40, first_bound=4, most_bound=16)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == exact(base, copy)


@pytest.mark.parametrize("most", [48, 1])
def test_difference_of_hot_keys_and_absent_rows(spark, most):
    """A copy without rows, half a copy, and one key with very many different rows: each in time linear in the rows."""
    base = spark.range(100_000).selectExpr("if(id % 3 = 0, null, id) as profile_id", "if(id % 3 = 0, null, 1) as frame_id", "cast(id as string) as name", "id as self_weight", "id as inclusive_weight")
    args = (["profile_id", "frame_id"], ["name", "self_weight", "inclusive_weight"])
    for copy, missing, fields in ((base.limit(0), 66_667, 0), (base.where("self_weight < 50000"), 33_333, 3), (base.where("self_weight % 3 > 0 or self_weight < 3000"), 0, 3)):
        got = table_difference(base, copy, *args, first_bound=min(12, most), most_bound=most).groupBy("field").count().collect()
        assert {r["field"]: r["count"] for r in got} == ({"missing_in_copy": missing} if missing else {}) | ({f: 1 for f in args[1]} if fields else {})


def test_difference_of_many_keys(spark, monkeypatch):
    monkeypatch.setattr("emberfold.operators.difference.MOST_KEYS_SENT", 0)
    monkeypatch.setattr("emberfold.operators.difference.MOST_BYTES_SENT", 0)
    base = spark.range(500).selectExpr("id as k", "cast(id % 7 as string) as v", "id as __a")
    copy = base.where("k % 10 > 0").withColumn("v", F.expr("if(k % 5 = 1, null, v)"))
    got = table_difference(base, copy, ["k"], ["v"]).groupBy("field").count().collect()
    assert {r["field"]: r["count"] for r in got} == {"missing_in_copy": 50, "v": 100}


def test_repeated_rows(spark):
    rows = [(1, ["a", None]), (1, ["a", None]), (1, [None, "a"]), (1, ["a"]), (None, []), (None, []), (None, []), (2, None), (2, None), (3, ["a"])]
    df = spark.createDataFrame(rows, "k bigint, f array<string>").withColumn("__more", F.lit("x"))
    assert {(r["k"], None if r["f"] is None else tuple(r["f"]), r["__more"]) for r in repeated(df, ["k", "f"]).collect()} == {(1, ("a", None), 1), (None, (), 2), (2, None, 1)}
    assert repeated(df.limit(0), ["k", "f"]).count() == 0


LINES = [
    ("folded", "a;b 1", None),
    ("folded", "  ", "blank"),
    ("folded", None, "blank"),
    ("folded", "a;b\x0b2", "invalid_folded_line"),
    ("folded", "a;b +007 \t\r", None),
    ("folded", " 5", "invalid_folded_line"),
    ("folded", "a;;b 5", "invalid_folded_line"),
    ("folded", "a;;b x", "invalid_weight"),
    ("folded", "a ++5", "invalid_weight"),
    ("folded", "a ٣", "invalid_weight"),
    ("folded", "a 000", "invalid_weight"),
    ("folded", "a 9007199254740991", None),
    ("folded", "a 9007199254740992", "weight_overflow"),
    ("folded", "a 99999999999999999999999999999999999999999", "weight_overflow"),
    ("folded", ";".join("a" * 4096) + " 1", None),
    ("folded", ";".join("a" * 4097) + " 1", "stack_too_deep"),
    ("csv", "1,2,a;b,3", None),
    ("csv", '1,"2","a,""q"";b",3', None),
    ("csv", '1,2,"a,3', "broken_quoting"),
    ("csv", '1,2,"a"x,3', "broken_quoting"),
    ("csv", '1,2,a"b",3', "broken_quoting"),
    ("csv", '1,2,"a""",""', "invalid_weight"),
    ("csv", "1,2,a", "column_count"),
    ("csv", "", "column_count"),
    ("csv", "1,2,a,3,4", "column_count"),
    ("csv", "1,2,,3", "invalid_folded_line"),
    ("csv", "1,2,a,3 ", "invalid_weight"),
    ("csv", '1,2,"' + ";".join(['x""'] * 5000) + '",3', "stack_too_deep"),
    ("xml", "a 1", "unknown_format"),
    (None, "a 1", "unknown_format"),
]


def test_bad_rows(spark):
    raw = spark.createDataFrame([(i, i, f, t, "r") for i, (f, t, _) in enumerate(LINES)], "raw_id bigint, profile_id bigint, fmt string, line string, reason string")
    bad = {r["raw_id"]: r["reason"] for r in failed_records(raw.drop("reason")).collect()}
    assert bad == {i: x for i, (_, _, x) in enumerate(LINES) if x not in (None, "blank")}
    good = {r["raw_id"]: (r["frames"], r["weight"], r["stack_id"]) for r in valid_records(raw).collect()}
    assert set(good) == {i for i, (_, _, x) in enumerate(LINES) if x is None}
    assert good[4] == (["a", "b"], 7, None) and good[17] == (['a,"q"', "b"], 3, 2)
    assert failed_records(raw.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_stack_counts(spark, sent, monkeypatch):
    """Also where hashes and names are too many to be sent to all tasks."""
    monkeypatch.setattr("emberfold.operators.repeats.MOST_CODES_SENT", sent)
    monkeypatch.setattr("emberfold.operators.skewed.MOST_NAMES_SENT", sent)
    records = [(1, 1, ["a", "b", "a"], 1), (1, 1, ["a", "b", "a"], 1), (1, 2, ["a", "b", "a"], 5), (1, 3, ["b"], None), (1, 4, None, 2), (1, 5, [], 2), (1, 6, ["c", None], 2), (None, 7, ["a"], 1)]
    df = spark.createDataFrame(records, "profile_id bigint, stack_id bigint, frames array<string>, weight bigint").withColumnRenamed("weight", "name")
    assert {tuple(r) for r in stacks_per_frame(df).collect()} == {(1, "a", 1), (1, "b", 2), (1, "c", 1), (None, "a", 1)}
    frames = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "frame_id int, name string")
    stored = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (1, 1, 3), (1, 3, None), (2, 3, 4), (None, 0, 1)], "profile_id bigint, frame_id int, stack_count int")
    got = {tuple(r) for r in counts_that_disagree(df, frames, stored).collect()}
    assert got == {(1, 1, 3, 2), (1, 2, 0, 1), (2, 3, 4, 0)}
    assert stacks_per_frame(df.limit(0)).count() == 0


def test_catalog_entries(spark):
    rows = [(1, "a-b.c_1", "x.y.folded", "0" * 64, 5, 0), (2, None, None, "0" * 63, None, None), (3, "a\n", ".folded", "G" * 64, 1, 86_400_000), (4, "ä", "bad name.folded", None, 1, -1), (5, "x" * 65, "noext", "a" * 64, 1, 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "profile_id bigint, alias string, source_name string, fingerprint string, byte_len bigint, registered_unix_ms bigint, entry string")
    got = {r["profile_id"]: tuple(r)[1:5] for r in checked_entries(df).collect()}
    assert got == {
        1: (True, "x.y", True, "1970-01-01"), 2: (False, "default", False, None), 3: (False, "default", False, "1970-01-02"),
        4: (False, "default", False, "1969-12-31"), 5: (False, "noext", True, "1970-01-01"),
    }
    assert '"alias":null' in checked_entries(df).where("profile_id = 2").first()["entry"] and checked_entries(df.limit(0)).count() == 0
