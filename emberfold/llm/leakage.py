"""Passages of held-out items inside a corpus, whole or in part, by SimHash.

Windows of several sizes are compared: each item in windows of its own size, the largest of a few size classes that it fills, and every item in all
its windows of the shortest passage that counts. A window has a 64-bit SimHash of its weighted five-word shingles. Item fingerprints are cut into
blocks, and each is entered under its blocks and, for the larger classes, under all values that differ from them in a few bits, so a document window
whose fingerprint lies within the radius agrees with an item window in one block at least and none is missed. The pairs found so are verified by the
exact weighted similarity of their shingles.

A document window of every class begins at every word: running sums of the shingles' bits give the fingerprints of all sizes. Texts are taken apart
once, however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, stored
from .tex import bare, word_table

SHINGLE, SIMILARITY = 5, 0.8
#: Each size class is so many times the one before.
GROWTH = 1.3
#: The words whose frequency in the items makes a shingle weigh less.
COMMON = 256
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)  # odd constants, one a place in a shingle
#: The most words whose windows are fingerprinted at once.
_AT_ONCE = 200_000


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words and, for each, the place of its text."""
    _, hashes, _, _, place = word_table([bare(t) for t in texts])
    return hashes, place


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    n = max(0, len(ids) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h += (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(29))) * _MIX[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


class Weights:
    """The weight of a shingle: 2 if at least three of its words aren't among the commonest of all items, else 1. It depends on the words only, not on
    where the shingle stands.
    """

    def __init__(self, common: list[int]) -> None:
        self.common = np.sort(np.array(common, dtype=np.uint64))
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.common & np.uint64(0xFFFF)] = True

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - SHINGLE + 1)
        rare = np.ones(len(ids), np.uint8)
        at = np.flatnonzero(self.maybe[ids & np.uint64(0xFFFF)])
        if len(at):
            place = np.minimum(np.searchsorted(self.common, ids[at]), len(self.common) - 1)
            rare[at] = self.common[place] != ids[at]
        held = rare[:n].copy()
        for k in range(1, SHINGLE):
            held += rare[k : k + n]
        return (held >= 3).astype(np.uint8) + np.uint8(1)


def fingerprints(shingles: np.ndarray, weights: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For each size the SimHash of each run of so many shingles: a bit is set if the shingles with it hold more than half of the weight.

    The 64 sums stand side by side in wide integers. A running sum overflows from one into the next, but the difference of two doesn't, as a window's
    sums fit.
    """
    out: dict[int, np.ndarray] = {}
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) * weights[:, None]
    of_weights = np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
    for kind, own in ((np.uint8, [s for s in sizes if 2 * s < 256]), (np.uint16, [s for s in sizes if 256 <= 2 * s < 65536])):
        if not own:
            continue
        lanes = np.ascontiguousarray(bits.astype(kind, copy=False)).view(np.uint64)
        sums = np.zeros((len(shingles) + 1, lanes.shape[1]), np.uint64)
        np.cumsum(lanes, axis=0, out=sums[1:])
        for s in own:
            half = ((of_weights[s:] - of_weights[:-s]) // 2).astype(kind) if s <= len(shingles) else np.zeros(0, kind)
            window = (sums[s:] - sums[:-s]).view(kind) if s <= len(shingles) else np.zeros((0, 64), kind)
            out[s] = np.packbits(window > half[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return [out[s] for s in sizes]


class Windows:
    """Item windows of one size with their fingerprints, found by any of ``blocks`` blocks of them, or by what differs from one in ``flips`` bits. So
    all within ``radius`` bits are found.
    """

    def __init__(self, size: int, prints: np.ndarray, start: np.ndarray, blocks: int, flips: int) -> None:
        self.size, self.prints, self.start, self.radius = size, prints, start, blocks * (flips + 1) - 1
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.blocks = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            own = (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            masks = np.array([sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(hi - lo), n)], np.uint64)
            slot = self._slot(own[:, None] ^ masks, hi - lo).ravel()
            entry = np.repeat(np.arange(len(prints)), len(masks))[np.argsort(slot, kind="stable")]
            count = np.bincount(slot, minlength=1 << min(18, hi - lo))
            self.blocks.append((lo, hi - lo, np.concatenate(([0], np.cumsum(count))), count > 0, entry))

    @staticmethod
    def _slot(block: np.ndarray, width: int) -> np.ndarray:
        """The place of a block's value in its table, which is a hash for wide blocks."""
        if width > 18:
            block = (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
        return block.astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``prints``, item window) whose fingerprints differ in at most ``radius`` bits."""
        found = []
        for lo, width, first, there, entry in self.blocks:
            slot = self._slot((prints >> np.uint64(lo)) & np.uint64((1 << width) - 1), width)
            maybe = np.flatnonzero(there[slot])
            slot = slot[maybe]
            count = first[slot + 1] - first[slot]
            if not len(count):
                continue
            a = np.repeat(maybe, count)
            b = entry[np.arange(len(a)) + np.repeat(first[slot] - np.cumsum(count) + count, count)]
            close = np.bitwise_count(prints[a] ^ self.prints[b]) <= self.radius
            found.append(a[close] * np.int64(len(self.prints)) + b[close])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))


def size_class(words: int, window: int) -> int:
    """The largest size class that a text of so many words fills; ``window`` is the smallest."""
    size = own = float(window)
    while int(size) <= words:
        own, size = size, size * GROWTH
    return int(own)


class Index:
    """The windows of a block of items in all size classes."""

    def __init__(self, ids: list, texts: list[str], window: int, radius: tuple[int, int], wide: tuple[int, int], weights: Weights) -> None:
        self.window, self.weights = window, weights
        self.ids, (self.words, self.place) = np.array(ids, dtype=np.int64), word_ids(texts)
        self.shingles, self.shingle_weights = shingle_hashes(self.words), weights(self.words)
        n = np.bincount(self.place, minlength=len(ids))
        begin = np.cumsum(n) - n
        starts = {window: [np.arange(b, b + k - window + 1) for b, k in zip(begin.tolist(), n.tolist(), strict=True) if k >= window]}
        for b, k in zip(begin.tolist(), n.tolist(), strict=True):
            if (size := size_class(k, window)) > window and k >= window:
                # its beginning, its middle and its end
                starts.setdefault(size, []).append(np.unique(b + np.array([0, (k - size) // 2, k - size])))
        self.classes: list[Windows] = []
        prints = dict(zip(starts, fingerprints(self.shingles, self.shingle_weights, [s - SHINGLE + 1 for s in starts]), strict=True)) if len(self.shingles) else {}
        for size in sorted(prints):
            at = np.concatenate(starts[size]) if starts[size] else np.zeros(0, np.int64)
            if len(at):
                self.classes.append(Windows(size, prints[size][at], at, *(radius if size == window else wide)))

    def similarity(self, shingles: np.ndarray, weights: np.ndarray, at: np.ndarray, item_at: np.ndarray, size: int) -> np.ndarray:
        """The exact weighted Jaccard similarity of the shingle sets of each pair of windows."""
        steps, out = np.arange(size - SHINGLE + 1), np.empty(len(at))
        block = max(1, 1_000_000 // len(steps))
        for lo in range(0, len(at), block):
            i, j = at[lo : lo + block, None] + steps, item_at[lo : lo + block, None] + steps
            both = np.hstack([shingles[i] & ~np.uint64(1), self.shingles[j] | np.uint64(1)])
            order = np.argsort(both, axis=1, kind="stable")
            both = np.take_along_axis(both, order, axis=1)
            w = np.take_along_axis(np.hstack([weights[i], self.shingle_weights[j]]), order, axis=1).astype(np.int64)
            new = np.append(np.ones((len(i), 1), bool), both[:, 1:] != both[:, :-1], axis=1)
            w *= new
            # the first of the item's copies stands right behind the last of the document's
            shared = np.append(np.zeros((len(i), 1), bool), new[:, 1:] & (both[:, 1:] ^ both[:, :-1] == 1), axis=1)
            common = (w * shared).sum(axis=1)
            out[lo : lo + len(i)] = common / (w.sum(axis=1) - common)
        return out

    def matches(self, words: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of texts taken apart: for each size class the places where windows begin, the item places they match, and the similarities."""
        for lo in range(0, len(words), _AT_ONCE):
            own = words[lo : lo + _AT_ONCE + self.classes[-1].size - 1]
            sh, w = shingle_hashes(own), self.weights(own)
            if not len(sh):
                continue
            for c, prints in zip(self.classes, fingerprints(sh, w, [c.size - SHINGLE + 1 for c in self.classes]), strict=True):
                prints = prints[:_AT_ONCE]
                a, b = c.near(prints)
                whole = place[lo + a] == place[lo + a + c.size - 1]
                a, b = a[whole], c.start[b[whole]]
                if len(a):
                    sim = self.similarity(sh, w, a, b, c.size)
                    alike = sim >= SIMILARITY
                    yield c.size, lo + a[alike], b[alike], sim[alike]


def _blocks(items: DataFrame, most_chars: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
        if size > most_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_OUT = "doc_id bigint, item_id bigint, similarity double, window bigint, windows bigint, run_words bigint"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts taken apart: an id and the hashes of the words, as bytes."""
    for batch in batches:
        for part in (batch.slice(lo, 16) for lo in range(0, batch.num_rows, 16)):
            flat, place = word_ids(part.column(1).to_pylist())
            cuts = np.searchsorted(place, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                names=["doc_id", "words"]
            )


def _scan(docs: DataFrame, sent: Broadcast, taken_apart: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for batch in batches if taken_apart else _words(batches):
            for part in (batch.slice(lo, 16) for lo in range(0, batch.num_rows, 16)):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                flat, place = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
                found = list(ix.matches(flat, place))
                if sum(len(a) for _, a, _, _ in found):
                    yield _rows(part.column(0).to_numpy(zero_copy_only=False), flat, place, ix, found)

    return docs.mapInArrow(run, _OUT)


def _rows(docs: np.ndarray, flat: np.ndarray, place: np.ndarray, ix: Index, found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each document and item; equal windows of the smallest size at one distance from each other form a run."""
    size = np.concatenate([np.full(len(a), s) for s, a, _, _ in found])
    a, b, sim = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
    doc, item, shift = docs[place[a]], ix.ids[ix.place[b]], a - b
    same = np.zeros(len(a), bool)
    small = np.flatnonzero(size == ix.window)
    steps = np.arange(ix.window)
    same[small] = (flat[a[small, None] + steps] == ix.words[b[small, None] + steps]).all(axis=1)
    order = np.lexsort((a, shift, ~same, item, doc))
    doc, item, a, shift, sim, same, size = (x[order] for x in (doc, item, a, shift, sim, same, size))
    pair = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
    new_run = pair | np.append(True, (shift[1:] != shift[:-1]) | (a[1:] != a[:-1] + 1) | ~same[1:])
    run_at = np.flatnonzero(new_run)
    length = np.where(same[run_at], np.diff(np.append(run_at, len(a))) + ix.window - 1, 0)
    starts = np.flatnonzero(pair)
    longest = np.maximum.reduceat(length, np.searchsorted(run_at, starts))
    counts = np.diff(np.append(starts, len(a)))
    largest = np.maximum.reduceat(size, starts)
    best = np.maximum.reduceat(np.where(size == np.repeat(largest, counts), sim, 0.0), starts)
    columns = [doc[starts], item[starts], best, largest, counts, longest]
    return pa.RecordBatch.from_arrays(
        [pa.array(c if c.dtype == float else c.astype(np.int64)) for c in columns],
        names=["doc_id", "item_id", "similarity", "window", "windows", "run_words"]
    )


def common_words(items: DataFrame, most: int = COMMON) -> list[int]:
    """The hashes of the ``most`` commonest words of the column ``t`` that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(word_ids(batch.column(0).to_pylist())[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    counted = items.select("t").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return [r["h"] % (1 << 64) for r in counted.orderBy(F.desc("n"), "h").limit(most).collect()]


def leaked_items(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 12,
    radius: tuple[int, int] = (3, 0), item_radius: tuple[int, int] = (4, 2), block_chars: int = 4_000_000,
) -> DataFrame:
    """``doc_id, item_id, similarity, window, windows, run_words``: one row for each document and item that have a window of one size class with a
    weighted similarity of 0.8 or more.

    The classes are ``window`` words, of which every item has all windows, and each item's own size: the largest ``window * GROWTH^k`` words that it
    fills, at its beginning, middle and end. ``window`` is the largest class with such a pair, ``similarity`` that of its most alike pair, ``windows``
    the number of pairs of all classes and ``run_words`` the length of the longest run of equal words, 0 if it is below the smallest class. ``radius``
    and ``item_radius`` are (blocks, bits flipped in a block) of the smallest and of the other classes; all fingerprints within ``blocks * (flips + 1)
    - 1`` bits are found, i.e. 2 and 11. Documents and items of fewer than ``window`` words, empty and null ones, and those without an id, match nothing; an empty table gives
    no rows. Repeated rows of a document give its row once. Items are read in blocks of ``block_chars`` characters, which bounds what a task holds and
    what is sent at once; if there are several, the corpus is taken apart once into a table that each block is held against.
    """
    corpus = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{doc_text}`").alias("text")).where("doc_id is not null and text is not null")
    known = items.where(F.col(f"`{item_text}`").isNotNull() & F.col(f"`{item_id}`").isNotNull()).select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t"))
    weights = Weights(common_words(known))
    indexes = (x for x in (Index(ids, texts, window, radius, item_radius, weights) for ids, texts in _blocks(known, block_chars)) if x.classes)
    first, second = next(indexes, None), next(indexes, None)
    if first is None:
        return docs.sparkSession.createDataFrame([], _OUT)
    send = docs.sparkSession.sparkContext.broadcast
    if second is None:
        out = _scan(corpus, send(first), False)
    else:
        apart, out = stored(corpus.mapInArrow(_words, "doc_id bigint, words binary")), None
        for index in chain((first, second), indexes):
            sent = send(index)
            found = materialize(_scan(apart, sent, True))
            sent.unpersist()  # so that the executors hold one block's windows at a time
            out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("window", "similarity")).alias("b"), F.max("windows").alias("windows"), F.max("run_words").alias("run_words")
    ).select("doc_id", "item_id", "b.similarity", "b.window", "windows", "run_words")
