"""Items of varying length in containers of fixed capacity, planned on lengths instead of items.

The number of items of each length is all that best fit needs, so the plan is made on a table of at most ``capacity`` rows,
whatever the number of items. It says, for each length, which ranks go to which containers; each item looks its slot up by its rank within its length,
so as many rows leave as come.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tex import INVERSE, MOST_TOGETHER, POWERS

#: Fixed value: the pattern that splits text before the merges of the vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


_SPACE, _LETTER, _DIGIT, _REST, _EDGE = range(5)


def _classes() -> np.ndarray:
    """What the pattern takes a character for; ``_EDGE`` stands for those that aren't told apart here."""
    out = np.full(0x110000, _EDGE, np.uint8)
    for c in (*range(0x500), *range(0x2010, 0x2028)):
        kind = unicodedata.category(chr(c))
        out[c] = _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _SPACE if chr(c) in "\t\n\v\f\r\x85" or kind[0] == "Z" else _REST
    return out


_CLASS = _classes()
_SURE = re.compile("[^\x00-\u04ff\u2010-\u2027]")
_END = "\U0010ffff"


def _pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each piece that the pattern splits texts into; ``points`` are their characters, with an ``_END`` after each
    text.
    """
    kind = _CLASS[points]
    at = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    kinds, size = kind[at], np.diff(np.append(at, len(points)))
    following = np.append(kinds[1:], _EDGE)
    begins = np.zeros(len(points), bool)
    space = kinds == _SPACE
    begins[at[space]] = True
    # white space before a word keeps its last character apart, and a blank goes with the word
    inner = space & (following != _EDGE)
    begins[(at + size - 1)[inner]] = True
    glued = np.append(False, points[at[1:] - 1] == 32)
    begins[at[~space & (~glued | (kinds == _EDGE))]] = True
    # an apostrophe that begins a piece takes one of seven endings
    q = np.flatnonzero((kinds == _REST) & (size == 1) & ~glued & (following == _LETTER) & (points[at] == 39))
    if len(q):
        word, length = at[q + 1], size[q + 1]
        first, second = points[word], points[np.minimum(word + 1, len(points) - 1)]
        one = np.isin(first, [115, 116, 109, 100])  # s t m d
        two = (length > 1) & (((first == 114) & (second == 101)) | ((first == 118) & (second == 101)) | ((first == 108) & (second == 108)))  # re ve ll
        taken = np.where(one, 1, np.where(two, 2, 0))
        begins[word[taken > 0]] = False
        more = (taken > 0) & (length > taken)
        begins[(word + taken)[more]] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(points))


class TokenCounter:
    """The numbers of tokens of texts. Merges never cross the pieces that the pattern splits a text into, so each distinct piece is merged once while
    it is kept.
    """

    def __init__(self, vocabulary: str, pattern: str = SPLIT_PATTERN, keep: int = 300_000) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known, self.keep, self.own_pattern = {}, keep, pattern != SPLIT_PATTERN

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out, some, size = np.zeros(len(texts), np.int64), [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.own_pattern or len(t) > MOST_TOGETHER or _SURE.search(t):
                out[i] = len(self.encode(t))
                continue
            if size + len(t) > MOST_TOGETHER:
                self._count(texts, some, out)
                some, size = [], 0
            some.append(i)
            size += len(t) + 1
        self._count(texts, some, out)
        return out

    def _count(self, texts: list[str | None], some: list[int], out: np.ndarray) -> None:
        if not some:
            return
        points = np.frombuffer("".join([texts[i] + _END for i in some]).encode("utf-32-le"), np.uint32)
        start, end = _pieces(points)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * POWERS[: len(points)], out=sums[1:])
        hashes = (sums[end] - sums[start]) * INVERSE[start]
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self.known = {}
        known, n = self.known, np.empty(len(distinct), np.int64)
        for k, h in enumerate(distinct.tolist()):
            if (c := known.get(h)) is None:
                piece = points[start[first[k]] : end[first[k]]].tobytes().decode("utf-32-le")
                c = known[h] = 0 if piece == _END else len(self.encode(piece))
            n[k] = c
        bounds = np.cumsum([len(texts[i]) + 1 for i in some])
        out[some] = np.bincount(np.searchsorted(bounds, start, "right"), weights=n[which], minlength=len(some))


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """``id, tokens``: the size of each text in tokens of a public vocabulary of ranked byte pairs, which each worker reads from ``vocabulary``. Null
    and empty texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(vocabulary, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()))], names=["id", "tokens"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tokens bigint")


def plan(sizes: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit by falling length over counts, as rows ``length, first rank, width, first container``: the item of rank r of a length goes to
    container ``first container + (r - first rank) % width``.

    Containers with the same room are one run of numbers, so a row fills as many at once as there are items or containers. Each step gives at most two
    rows, and either ends a length, which leaves at most three runs more, or leaves a run with less than half of its room. So there are at most ``2 *
    lengths * (1 + 3 * log2(capacity))`` rows, whatever the number of items.
    """
    out: list[tuple[int, int, int, int]] = []
    rooms: list[int] = []  # ascending, the room of some open containers
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first container, number)
    opened = 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in runs:
                insort(rooms, room)
            runs[room].append((first, number))

    for length in sorted((x for x in sizes if x > 0), reverse=True):
        left, rank = sizes[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            else:
                room = rooms[k]
                first, number = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(k)
            # the tightest container stays the tightest until no more of this length fit, so containers are filled one after the other
            each = room // length
            full = min(number, left // each)
            if full:
                out.append((length, rank, full, first))
                rank += full * each
            left -= full * each
            put(room - each * length, first, full)
            rest = min(left, each) if full < number else 0
            if rest:
                out.append((length, rank, 1, first + full))
                rank += rest
                left -= rest
                put(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            put(room, first + used, number - used)
    return np.array(out, np.int64).reshape(-1, 4)


def slots_of(entries: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The container of each item, by its length and its rank within that: a binary search in the plan. Items of no length are in container 0."""
    if not len(entries):
        return np.zeros(len(size), np.int64)
    order = np.lexsort((entries[:, 1], entries[:, 0]))
    length, first_rank, width, first = entries[order].T
    # places of the lengths, then of the ranks within them
    lo, hi = np.searchsorted(length, size, "left"), np.searchsorted(length, size, "right")
    while (open_ := hi - lo > 1).any():
        middle = (lo + hi) // 2
        right = open_ & (first_rank[np.minimum(middle, len(length) - 1)] <= rank)
        lo, hi = np.where(right, middle, lo), np.where(open_ & ~right, middle, hi)
    lo = np.minimum(lo, len(length) - 1)
    return np.where(size > 0, first[lo] + (rank - first_rank[lo]) % width[lo], 0)


def pack(sized: DataFrame, *, capacity: int = 4096, part_rows: int = 200_000) -> DataFrame:
    """``id, piece, tokens, first_token, size, container`` from ``id, tokens``: every item in a container of ``capacity``, in pieces if and only if it
    is larger.

    A larger item gives full pieces, each a container of its own, and a rest that is packed as an item. ``first_token`` is a piece's place in its
    item. Items of no tokens stand in container 0 and take no room; a null size counts as 0. Repeated rows are items of their own. No two containers
    could be poured into one by a best fit that sees all lengths first. Ranks within a length are counted in parts of about ``part_rows`` items, so
    the tasks follow the counts and a length that most items have isn't ranked in one. An empty table gives no rows.
    """
    spark = sized.sparkSession
    items = sized.select("id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("tokens"))
    whole = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / capacity)  # full pieces before the last one
    pieces = items.select("id", "tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece")).select(
        "id", "tokens", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(
            F.lit(capacity), F.col("tokens") - F.col("piece") * capacity
        ).cast("bigint").alias("size")
    )
    # at most capacity + 1 rows
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = spark.createDataFrame([(x, -(-n // part_rows)) for x, n in sorted(counts.items())], "size bigint, parts bigint")
    keyed = pieces.join(F.broadcast(parts), "size").withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.col("parts"))).drop("parts")
    offsets = keyed.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.expr("sum(n) over (partition by size order by part) - n")
    ).select("size", "part", "before")
    ranked = keyed.withColumn("own", F.expr("row_number() over (partition by size, part order by id, piece)")).join(offsets, ["size", "part"])
    # the plan's size has a bound, which depends on the capacity only
    sent = spark.sparkContext.broadcast(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slots_of(sent.value, size, rank))], names=["id", "piece", "tokens", "first_token", "size", "container"]
            )

    rows = ranked.select("id", F.col("piece").cast("int"), "tokens", "first_token", "size", (F.col("own") - 1 + F.col("before")).cast("bigint").alias("rank"))
    return rows.mapInArrow(place, f"id {rows.schema['id'].dataType.simpleString()}, piece int, tokens bigint, first_token bigint, size bigint, container bigint")
