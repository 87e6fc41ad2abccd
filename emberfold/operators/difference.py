"""Differences between two copies of a table, found by set reconciliation.

Each side turns every distinct row into one element of GF(2^61 - 1) and every bucket of rows into the values of its characteristic polynomial at a few
points. Only these values meet. The quotient of both sides' values is a rational function whose numerator and denominator vanish at the rows held by
one side only; both are interpolated under a degree bound that doubles, for the buckets that fail verification. The coefficients go back to the sides,
where a bucket's own elements that are roots are the rows that the other side lacks. The keys of these rows are then fetched from both sides and
compared exactly.

Buckets are hashes of whole rows, so no key fills one, whatever number of different rows it has. A bucket that only one side has differs as a whole;
one whose differences exceed ``most_bound`` has no sketch that is smaller than its elements, so the elements themselves are held against each other.
All of it is linear in the rows at any rate of differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, stored

P = (1 << 61) - 1
_M61, _M31, _M30 = np.uint64(P), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Values beyond the degree bound, which a wrong function meets with a chance of about (degree / 2^61)^CHECKS.
CHECKS = 2
#: Elements are at or above it and points of evaluation below.
FIRST_ELEMENT = 4096
#: The most bytes of polynomials that are sent to all tasks; beyond, they are joined by bucket.
MOST_BYTES_SENT = 16 << 20
#: The most affected keys (8 bytes each) that are sent to all tasks; beyond, the tables are joined by hash.
MOST_KEYS_SENT = 1_000_000


def mul_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in GF(2^61 - 1) of uint64 values below 2^61."""
    s31, s30, s61 = np.uint64(31), np.uint64(30), np.uint64(61)
    a1, a0, b1, b0 = a >> s31, a & _M31, b >> s31, b & _M31
    mid = a0 * b1 + a1 * b0
    r = ((a1 * b1) << np.uint64(1)) + (mid >> s30) + ((mid & _M30) << s31) + a0 * b0
    r = (r & _M61) + (r >> s61)
    return np.where(r >= _M61, r - _M61, r)


def characteristic(h: np.ndarray, starts: np.ndarray, points: int) -> np.ndarray:
    """For each run of ``h`` that begins at ``starts``: the product of (z - h) at z = 1..points."""
    z = np.arange(1, points + 1, dtype=np.uint64)
    values = np.where(z[None, :] >= h[:, None], z[None, :] - h[:, None], z[None, :] + _M61 - h[:, None])
    size = np.diff(np.append(starts, len(h)))
    while len(values) > len(size):  # halves every run: neighbours are multiplied, an odd last row stays
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        at = np.arange(len(values)) - np.repeat(first, size)
        left = at % 2 == 0
        paired = left & (at + 1 < np.repeat(size, size))
        out = values[left]
        out[paired[left]] = mul_mod(values[paired], values[np.flatnonzero(paired) + 1])
        values, size = out, (size + 1) // 2
    return values


def sub_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _M61 - b)


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverses of elements that aren't 0, by Fermat's theorem; 0 stays 0."""
    out, square = None, a
    for bit in reversed(bin(P - 2)[2:]):
        if bit == "1":
            out = square if out is None else mul_mod(out, square)
        square = mul_mod(square, square)
    return out


def interpolate(a: np.ndarray, b: np.ndarray, degree_a: np.ndarray, degree_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of values at 1, 2, ..: coefficients of monic ``num`` and ``den`` of the given degrees with ``num / den = a / b``, the degree of
    what both have in common, and whether the further values agree.

    ``degree_a + degree_b`` is the same number ``m`` for all rows; the first ``m`` values give one linear system for each row, solved by elimination
    in all rows at once. Each difference that a pair has less than ``m`` takes one from the system's rank and stands in both polynomials as a factor.
    """
    rows, points = a.shape
    m = int(degree_a[0] + degree_b[0])
    z = np.ones((points, m + 1), np.uint64)
    for i in range(m):
        z[:, i + 1] = mul_mod(z[:, i], np.arange(1, points + 1, dtype=np.uint64))
    f = mul_mod(a, inverse(b))
    minus_f = sub_mod(np.zeros_like(f), f)
    column = np.arange(m)[None, :]
    of_a = column < degree_a[:, None]
    power = np.where(of_a, column, column - degree_a[:, None])
    powers = z[np.arange(m)[None, :, None], power[:, None, :]]
    system = np.empty((rows, m, m + 1), np.uint64)
    system[:, :, :m] = np.where(of_a[:, None, :], powers, mul_mod(powers, minus_f[:, :m, None]))
    system[:, :, m] = sub_mod(mul_mod(f[:, :m], z[np.arange(m)[None, :], degree_b[:, None]]), z[np.arange(m)[None, :], degree_a[:, None]])
    at = np.arange(rows)
    used, solved_by = np.zeros((rows, m), bool), np.full((rows, m), -1)
    for c in range(m):
        usable = (system[:, :, c] != 0) & ~used
        row = usable.argmax(axis=1)
        has = usable[at, row]
        own = system[at, row, c:]
        own = np.where(has[:, None], mul_mod(own, inverse(own[:, 0])[:, None]), np.uint64(0))
        factor = system[:, :, c].copy()
        factor[at, row] = 0
        system[:, :, c:] = sub_mod(system[:, :, c:], mul_mod(factor[:, :, None], own[:, None, :]))
        system[at[has], row[has], c:] = own[has]
        used[at[has], row[has]] = True
        solved_by[:, c] = np.where(has, row, -1)
    value = np.where(solved_by >= 0, system[at[:, None], np.maximum(solved_by, 0), m], np.uint64(0))
    num, den = np.zeros((rows, m + 1), np.uint64), np.zeros((rows, m + 1), np.uint64)
    r, c = np.nonzero(of_a)
    num[r, power[r, c]] = value[r, c]
    r, c = np.nonzero(~of_a)
    den[r, power[r, c]] = value[r, c]
    num[at, degree_a] = 1
    den[at, degree_b] = 1
    fits = np.ones(rows, bool)
    for k in range(m, points):
        fits &= horner(num, np.uint64(k + 1)) == mul_mod(f[:, k], horner(den, np.uint64(k + 1)))
    return num, den, (solved_by < 0).sum(axis=1), fits


def horner(coefficients: np.ndarray, x: np.ndarray | np.uint64) -> np.ndarray:
    """The value of each row's polynomial (lowest coefficient first) at the row's ``x``."""
    out = coefficients[:, -1]
    for i in range(coefficients.shape[1] - 2, -1, -1):
        out = mul_mod(out, x) + coefficients[:, i]
        out = np.where(out >= _M61, out - _M61, out)
    return out


def reconcile(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``solved, num, den, only_a, only_b`` of pairs of sets, from their sizes and their values at 1..bound + CHECKS: the polynomials among whose
    roots are the elements of either side only, and the numbers of these.

    A pair has a parity that the difference of its sizes gives, so pairs of even and odd bounds are solved apart. A pair isn't solved if the bound is
    too low for it.
    """
    d = n_a - n_b
    rows = len(d)
    num, den = np.zeros((rows, bound + 1), np.uint64), np.zeros((rows, bound + 1), np.uint64)
    only_a, only_b, solved = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, bool)
    for m in (bound, bound - 1):
        own = np.flatnonzero(((d - m) % 2 == 0) & (np.abs(d) <= m))
        step = max(1, 1_000_000 // (m * m + 1))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            of_a, of_b = (m + d[part]) // 2, (m - d[part]) // 2
            p, q, common, fits = interpolate(a[part], b[part], of_a, of_b)
            num[part, : m + 1], den[part, : m + 1] = p, q
            only_a[part], only_b[part] = of_a - common, of_b - common
            solved[part] = fits & (only_a[part] >= 0) & (only_b[part] >= 0)
    return solved, num, den, only_a, only_b


def _hash(names: list[str], salt: str) -> Column:
    """Nulls hash as values of their own."""
    return F.xxhash64(F.lit(salt), *[x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def _lists(starts: np.ndarray, *flat: np.ndarray) -> list[pa.Array]:
    ends = pa.array(np.append(starts, len(flat[0])).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in flat]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists and where each list begins, with the end of the last."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _packets(df: DataFrame, key: list[str], fields: list[str], buckets: int) -> DataFrame:
    """``bucket, hs, ks``: the elements of one side's different rows and the hashes of their keys, a row for each bucket. Repeated rows are dropped
    within batches before they move and for good behind the shuffle.
    """
    element = F.pmod(_hash(key + fields, "row"), F.lit(P - FIRST_ELEMENT)) + FIRST_ELEMENT
    rows = df.select(F.pmod(_hash(key + fields, "bucket"), F.lit(buckets)).alias("bucket"), element.alias("h"), _hash(key, "key").alias("k"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_index=True)
            yield batch if len(first) == batch.num_rows else batch.take(pa.array(first))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def out(b: np.ndarray, h: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(b[starts]), *_lists(starts, h, k)], names=["bucket", "hs", "ks"])

        for batch in batches:
            b, h, k = (np.concatenate((x, batch.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(held))
            if not len(b):
                continue
            new = np.append(True, (b[1:] != b[:-1]) | (h[1:] != h[:-1]))
            b, h, k = b[new], h[new], k[new]
            last = int(np.searchsorted(b, b[-1]))  # its rows may go on in the next batch
            if last:
                yield out(b[:last], h[:last], k[:last])
            held = [b[last:], h[last:], k[last:]]
        if len(held[0]):
            yield out(*held)

    schema = "bucket bigint, h bigint, k bigint"
    moved = rows.mapInArrow(once, schema).repartition("bucket").sortWithinPartitions("bucket", "h")
    return moved.mapInArrow(gather, "bucket bigint, hs array<bigint>, ks array<bigint>")


def _sketch(packets: DataFrame, points: int, side: str) -> DataFrame:
    """``bucket, n_<side>, <side>``: the number of elements and the values of their characteristic polynomial at 1..points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, 1000) for lo in range(0, batch.num_rows, 1000)):
                h, ends = _flat(part.column(1))
                values = characteristic(h.astype(np.uint64), ends[:-1], points)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends)), *_lists(np.arange(len(values)) * points, values.reshape(-1))],
                    names=["bucket", f"n_{side}", side]
                )

    return packets.select("bucket", "hs").mapInArrow(run, f"bucket bigint, n_{side} bigint, {side} array<bigint>")


def _solve(pairs: DataFrame, bound: int) -> DataFrame:
    """``bucket, solved, a, b, only_a, only_b``: each side's polynomial and how many of its elements are roots. If one side has nothing, the other's
    polynomial is 0, of which all elements are roots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [x.to_numpy(zero_copy_only=False) for x in (pc.fill_null(batch.column(1), 0), pc.fill_null(batch.column(3), 0))]
            values = []
            for i in (2, 4):
                there = batch.column(i).is_valid().to_numpy(zero_copy_only=False)
                own = np.ones((batch.num_rows, bound + CHECKS), np.uint64)
                own[there] = batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, bound + CHECKS)
                values.append(own)
            solved, num, den, only_a, only_b = reconcile(*n, *values, bound)
            for own, other, poly, only, rest in ((n[0], n[1], num, only_a, only_b), (n[1], n[0], den, only_b, only_a)):
                alone = (other == 0) & (own > 0)
                poly[alone], only[alone], rest[alone], solved[alone] = 0, own[alone], 0, True
            starts = np.arange(batch.num_rows) * (bound + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(solved), *_lists(starts, num.reshape(-1), den.reshape(-1)), pa.array(only_a), pa.array(only_b)],
                names=["bucket", "solved", "a", "b", "only_a", "only_b"]
            )

    return pairs.mapInArrow(run, "bucket bigint, solved boolean, a array<bigint>, b array<bigint>, only_a bigint, only_b bigint")


def _roots(packets: DataFrame, solved: DataFrame, side: str, few: bool) -> DataFrame:
    """``bucket, k``: the key hashes of this side's elements that are roots; a null one for a bucket with another number of them than the solution
    has.
    """
    asked = solved.where(F.col("solved") & (F.col(f"only_{side}") > 0)).select("bucket", F.col(side).alias("poly"), F.col(f"only_{side}").alias("only"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, 1000) for lo in range(0, batch.num_rows, 1000)):
                h, ends = _flat(part.column(1))
                k, _ = _flat(part.column(2))
                poly = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(part.num_rows, -1)
                place = np.repeat(np.arange(part.num_rows), np.diff(ends))
                root = horner(poly[place], h.astype(np.uint64)) == 0
                bucket = part.column(0).to_numpy(zero_copy_only=False)
                wrong = bucket[np.bincount(place[root], minlength=part.num_rows) != part.column(4).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(bucket[place[root]], wrong)),
                        pa.array(np.append(k[root], wrong), mask=np.append(np.zeros(root.sum(), bool), np.ones(len(wrong), bool)))
                    ],
                    names=["bucket", "k"]
                )

    return packets.join(F.broadcast(asked) if few else asked, "bucket").mapInArrow(run, "bucket bigint, k bigint")


def table_difference(
    base: DataFrame, copy: DataFrame, key: list[str], fields: list[str], *, bucket_rows: int = 32, first_bound: int = 12, most_bound: int = 48
) -> DataFrame:
    """Differing rows of two copies: ``key columns, field``, where ``field`` is ``missing_in_copy``, ``missing_in_base`` or a name of ``fields``.

    Repeated rows count once; row order and columns other than ``key`` and ``fields`` don't matter. Null equals only null, in keys too. If one side
    has several different rows of a key, a field differs unless both sides have the same set of values. Two empty tables give no rows; an empty side
    makes all keys of the other missing. ``bucket_rows`` is the mean size of a bucket; ``first_bound`` is the degree bound of the first round, doubled
    for unsolved buckets up to ``most_bound``; buckets with more differences are compared element by element. Differing rows go unseen only if their
    61-bit elements agree inside a bucket.
    """
    rows = max(base.count(), copy.count())
    buckets = max(1, -(-rows // bucket_rows))
    own = [stored(_packets(x, key, fields, buckets)) for x in (base, copy)]
    found: list[DataFrame] = []
    left, bound = own, first_bound
    while True:
        a, b = (_sketch(x, bound + CHECKS, s) for x, s in zip(left, "ab", strict=True))
        # sides whose values all agree hold the same rows
        pairs = a.join(b, "bucket", "full_outer").where(~F.coalesce((F.col("n_a") == F.col("n_b")) & (F.col("a") == F.col("b")), F.lit(False)))
        solved = stored(_solve(pairs.select("bucket", "n_a", "a", "n_b", "b"), bound))
        few = solved.count() * 16 * (bound + 1) <= MOST_BYTES_SENT
        roots = [_roots(x, solved, s, few) for x, s in zip(left, "ab", strict=True)]
        result = materialize(roots[0].unionByName(roots[1]).unionByName(solved.where(~F.col("solved")).selectExpr("bucket", "cast(null as bigint) as k")))
        found.append(result.where("k is not null").select("k"))
        open_ = result.where("k is null").select("bucket").distinct()
        if open_.isEmpty():
            break
        left = [x.join(open_, "bucket", "left_semi") for x in left]
        bound *= 2
        if bound > most_bound:
            each = [x.select("bucket", F.explode(F.arrays_zip("hs", "ks")).alias("e"), F.lit(s).alias("s")) for s, x in enumerate(left)]
            alone = each[0].unionByName(each[1]).groupBy("bucket", F.col("e.hs").alias("h")).agg(
                F.first("e.ks").alias("k"), F.min("s").alias("low"), F.max("s").alias("high")
            )
            found.append(alone.where("low = high").select("k"))
            break
    affected = found[0]
    for x in found[1:]:
        affected = affected.unionByName(x)
    affected = materialize(affected.distinct())
    affected = F.broadcast(affected) if affected.count() <= MOST_KEYS_SENT else affected
    fetched = []
    for s, x in enumerate((base, copy)):
        own_rows = x.select(*[F.col(f"`{c}`") for c in key + fields], _hash(key, "key").alias("__k")).join(affected.withColumnRenamed("k", "__k"), "__k", "left_semi")
        fetched.append(own_rows.drop("__k").withColumns({"__a": F.lit(s == 0), "__b": F.lit(s == 1)}))
    return _compare(fetched[0].unionByName(fetched[1]), key, fields)


def _compare(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The exact comparison of the fetched rows, one aggregation by value and one by key."""
    keys = [F.col(f"`{c}`") for c in key]
    entries = F.array(
        F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(fields)],
    )
    values = (
        rows.select(*keys, "__a", "__b", F.explode(entries).alias("__e"))
        .groupBy(*keys, F.col("__e.at").alias("__at"), F.col("__e.value").alias("__value"))
        .agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    )
    whole = F.col("__at").isNull()
    by_key = values.groupBy(*keys).agg(
        F.max(F.when(whole, F.col("__a"))).alias("__in_a"),
        F.max(F.when(whole, F.col("__b"))).alias("__in_b"),
        *[F.max(F.when((F.col("__at") == i), F.col("__a") != F.col("__b"))).alias(f"__d{i}") for i in range(len(fields))],
    )
    differing = F.array_compact(F.array(*[F.when(F.col(f"__d{i}"), F.lit(c)) for i, c in enumerate(fields)]))
    said = F.when(~F.col("__in_b"), F.array(F.lit("missing_in_copy"))).when(~F.col("__in_a"), F.array(F.lit("missing_in_base"))).otherwise(differing)
    return by_key.select(*keys, F.explode(said).alias("field"))
