"""The operators of the subpackage against plain restatements on small tables, with nulls, ties, repeated, empty and very long ones."""

import itertools
import random
import re
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberfold.llm.heavy_hitters import LossyCounter, exact_figures, frequent_items
from emberfold.llm.language import Model, Scorer, _files, _sample, _share, body, fit, languages, pieces
from emberfold.llm.leakage import Index, Weights, Windows, fingerprints, leaked_items, shingle_hashes, size_class, word_ids
from emberfold.llm.packing import SPLIT_PATTERN, VOCABULARY, TokenCounter, pack, plan, slots_of, token_counts
from emberfold.llm import subsequences as subsequences_module
from emberfold.llm.subsequences import distinct_stacks, frequent_paths, frequent_subsequences, mine, parts_by_pivot, shortened
from emberfold.llm.tex import bare, word_table

# Frequent subsequences


def subsequences(s, longest):
    return {c for n in range(1, longest + 1) for c in itertools.combinations(s, n)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=12), max_size=4), st.integers(1, 4), st.sampled_from([3, 2_000_000]))
def test_shortening_keeps_all_short_subsequences(seqs, longest, places):
    code, row = np.array([x for s in seqs for x in s], np.uint8), np.repeat(np.arange(len(seqs)), [len(s) for s in seqs]).astype(np.int64)
    kept, own = shortened(code, row, longest)
    got = defaultdict(list)
    with mock.patch.object(subsequences_module, "MOST_PLACES", places):
        for r, pivot, size, flat in parts_by_pivot(code, row, 1, longest):
            for i, p, part in zip(r.tolist(), pivot.tolist(), np.split(flat, np.cumsum(size)[:-1]), strict=True):
                got[i].append((p, part.tolist()))
    for i, seq in enumerate(seqs):
        assert subsequences(seq, longest) == subsequences(kept[own == i].tolist(), longest)
        assert sorted(p for p, _ in got[i]) == sorted(set(seq))
        for pivot, part in got[i]:
            assert {s for s in subsequences(seq, longest) if max(s) == pivot} == {s for s in subsequences(part, longest) if max(s) == pivot}


def test_recursion_is_bounded():
    """However deep two items alternate, a few places hold all subsequences of four."""
    code = np.array([0, 1] * 2000 + [2] + [1] * 50, np.uint8)
    assert len(shortened(code, np.zeros(len(code), np.int64), 4)[0]) <= 16


def test_wide_rows_are_mined_in_little_memory():
    """1,000 parts of 200 items out of 1,000: well under 1 GB, as nothing is held for each item."""
    import tracemalloc

    rng = np.random.default_rng(2)
    code, size = rng.integers(0, 1000, 200_000).astype(np.uint16), np.full(1000, 200)
    code[::200] = 999
    tracemalloc.start()
    got = mine(code, size, np.ones(1000, np.int64), np.ones(1000, np.int64), 999, 3, 4, 40, float("inf"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and all(n >= 40 for _, n, _ in got)


@pytest.mark.parametrize("block_bytes", [40, 4 << 20])
def test_frequent_subsequences(spark, block_bytes):
    rng = random.Random(block_bytes)
    seqs = [([rng.choice("aaabcdé ") for _ in range(rng.randrange(0, 9))], rng.choice([None, 0, 1, 5, 40])) for _ in range(150)] + [(None, 9), (["a", None, "b", "a"], 3), ([None], 1)] + [(["a", "b"] * 200, 1)]
    df = spark.createDataFrame([(f, w, "x") for f, w in seqs], "frames array<string>, weight bigint, item string")
    got = {(tuple(r["steps"]), r["support"], r["weight"]) for r in frequent_subsequences(df, count_share=(6, 100), weight_share=(7, 100), block_bytes=block_bytes).collect()}
    n, w = Counter(), Counter()
    held = [(f, x or 0) for f, x in seqs if f is not None]
    for f, x in held:
        f = [y for y in f if y is not None]
        for s in subsequences(f if len(f) < 30 else f[:8], 4):  # eight of two alternating items hold all patterns of four
            if len(s) >= 3:
                n[s] += 1
                w[s] += x
    total = sum(x for _, x in held)
    assert got == {(s, n[s], w[s]) for s in n if n[s] * 100 >= 6 * len(held) or w[s] * 100 >= 7 * total} and got
    assert frequent_subsequences(df.limit(0), count_share=(1, 10), weight_share=(1, 10)).count() == 0


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_stacks_are_distinct(spark, sent, monkeypatch):
    monkeypatch.setattr("emberfold.operators.repeats.MOST_CODES_SENT", sent)
    rows = [(1, 1, ["a"], 2), (1, 1, ["a"], 2), (1, 2, ["a"], 3), (1, 3, ["a"], None), (1, 4, None, 7), (2, 1, ["a"], None)]
    df = spark.createDataFrame(rows, "profile_id bigint, stack_id bigint, frames array<string>, weight bigint")
    assert {(r[0], tuple(r[1]), r[2]) for r in distinct_stacks(df).collect()} == {(1, ("a",), 5), (2, ("a",), 0)}


def test_frequent_paths(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), i, [rng.choice(["a", "b", "é;", None]) for _ in range(rng.randrange(0, 7))], rng.choice([None, 2, 9])) for i in range(120)] + [(1, 500, None, 3)]
    df = spark.createDataFrame(rows + rows[::9], "profile_id bigint, stack_id bigint, frames array<string>, weight bigint")
    args = {"count_share": (10, 100), "weight_share": (12, 100)}
    named = lambda x: {(tuple(r["steps"]), *r[1:]) for r in x.collect()}
    got = named(frequent_paths(df, **args))
    assert got == named(frequent_subsequences(distinct_stacks(df), **args)) and got
    assert frequent_paths(df.limit(0), **args).count() == 0
    assert frequent_paths(df, count_share=(1, 1), weight_share=(1, 1)).count() == 0


# Most frequent items


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9)), max_size=400), st.sampled_from([0.02, 0.1, 0.3]))
def test_lossy_bounds(rows, epsilon):
    c, true = LossyCounter(epsilon), Counter()
    for lo in range(0, len(rows), 7):
        part = Counter()
        for x, n in rows[lo : lo + 7]:
            part[x] += n
        c.add(list(part), list(part.values()), sum(part.values()))
        true.update(part)
    for x, n in true.items():
        low, delta = c.entries.get(x, [0, c.bound])
        assert low <= n <= low + delta and delta <= epsilon * c.mass


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_frequent_items(spark, sent, monkeypatch):
    monkeypatch.setattr("emberfold.operators.repeats.MOST_CODES_SENT", sent)
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "hot", f"x{rng.randrange(40)}", f"r{i}"]), rng.choice([None, 0, 1, 3])) for i in range(6000)]
    rows += rows[::50] + [(9000, "heavy", 900), (None, "hot", 1), (None, "hot", 1)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "hit_id bigint, name string, self_weight bigint, item string").repartition(5)
    args = {"key": "hit_id", "item": "name", "weight": "self_weight", "share": 0.004, "epsilon": 0.0004}
    found = frequent_items(df, **args)
    n, w = Counter(), Counter()
    for k, x, y in {r for r in rows if r[0] is not None} | {(-i, *r[1:]) for i, r in enumerate(rows, 1) if r[0] is None}:
        n[x] += 1
        w[x] += y or 0
    want = {("rows", x) for x in n if x and n[x] >= 0.004 * n.total()} | {("weight", x) for x in w if x and w[x] >= 0.004 * w.total()}
    got = {(r["basis"], r["item"]): r for r in found.collect()}
    assert want <= set(got) and ("weight", "heavy") in got
    for (basis, x), r in got.items():
        true = (n if basis == "rows" else w)
        assert r["low"] <= true[x] <= r["high"] and r["mass"] == true.total() and r["high"] - r["low"] <= 0.00042 * r["mass"] + 1
    for r in exact_figures(df, found, **args).collect():
        assert (r["rows"], r["weight"]) == (n[r["item"]], w[r["item"]])
    assert frequent_items(df.limit(0), **args).count() == 0


# Containers


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=12))
def test_plan_is_best_fit(sizes):
    capacity, used, seen = 30, Counter(), Counter()
    entries = plan(sizes, capacity)
    assert len(entries) <= 2 * len(sizes) * (1 + 3 * np.log2(capacity))
    for length, number in sizes.items():
        for c in slots_of(entries, np.full(number, length), np.arange(number)).tolist():
            used[c] += length
        seen[length] += number
    room = []
    for x in sorted((x for x, n in sizes.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(capacity - x)
    assert seen == Counter(sizes) and sorted(used) == list(range(len(room))) and sorted(used.values()) == sorted(capacity - r for r in room)


def test_pack(spark):
    sizes = [0, None, 1, 10, 10, 10, 4096, 4097, 9000, 8192, 4000, 95, 96, 97, *[300] * 60]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)] + [(5, 10, 1)], "id bigint, tokens bigint, size int")
    rows = pack(df, capacity=4096, part_rows=7).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["container"]].append(r)
    assert all(sum(r["size"] for r in x) <= 4096 for x in held.values())
    for i, n in enumerate(sizes):
        own = sorted((r["first_token"], r["size"]) for r in rows if r["id"] == i)
        if i != 5:
            assert len(own) == max(1, -(-(n or 0) // 4096)) and sum(s for _, s in own) == (n or 0) and all(a == 4096 * k for k, (a, _) in enumerate(own))
    assert sum(r["id"] == 5 for r in rows) == 2
    assert len(held) <= -(-sum(filter(None, sizes)) // 4096) + 1
    assert pack(df.limit(0)).count() == 0


def test_token_counts(spark):
    count = TokenCounter(VOCABULARY)
    rng = random.Random(1)
    bits = ["a", "b", "'s", "'", " ", " ", "\n", "\t", "'ll", "'re", "s", "_", "1", "٣", "é", "\u0301", "ж", "\xa0", "\x85", ".", "–", "“", "ª", "\xad", "\u200b", "\x1c", "²", "𝒳", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(3000)] + ["word " * 300_000, "x" * 3000, None, ""]
    assert count(texts).tolist() == [len(count.encode(t)) if t else 0 for t in texts]
    assert TokenCounter(VOCABULARY, SPLIT_PATTERN.replace("'ll|", ""))(["we'll"])[0] > 0
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x")], "doc_id bigint, text string, tokens string")
    assert sorted(tuple(r) for r in token_counts(df).collect()) == [(1, 2), (2, 0), (3, 0)]


# Words and leaked passages


def read(text):
    whole, _, start, end, _ = word_table([bare(text)])
    return [whole[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Gr{\\\"o}{\\ss}e na\\\"{\\i}ve \\'Elan gar\\c{c}on cr{\\'{\\i}}tico", "größe naïve élan garçon crítico"),
        ("a \\emph{b} {\\bf c.} d~e\\ f \\cite[p. 1]{g}h", "a b c d e f h"),
        ("% sol-\n% ution, ex-\nact", "solution exact"),
        ("A_b «c» – D2 E\u0301", "a b c d2 é"),
        (None, ""),
        ("", ""),
    ],
)
def test_words(text, expected):
    assert " ".join(read(text)) == expected


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abé1") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 400))) for _ in range(60)] + ["y" * 3_000_000 + " z " + "w " * 400_000]
    whole, hashes, start, end, place = word_table([bare(t) for t in texts])
    seen = {}
    for h, a, b in zip(hashes.tolist(), start.tolist(), end.tolist(), strict=True):
        assert seen.setdefault(h, whole[a:b].tobytes()) == whole[a:b].tobytes()
    assert len(set(seen.values())) == len(seen) and np.bincount(place, minlength=61).tolist() == [len(t.split()) for t in texts]


@pytest.mark.parametrize("blocks, flips", [(3, 0), (4, 2), (1, 1)])
def test_blocks_miss_none(blocks, flips):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    ix = Windows(12, prints, np.arange(300), blocks, flips)
    asked = prints.copy()
    for i in range(300):
        for b in rng.choice(64, i % (ix.radius + 2), replace=False).tolist():
            asked[i] ^= np.uint64(1 << b)
    a, b = ix.near(asked)
    want = {(i, j) for i, x in enumerate(asked.tolist()) for j, y in enumerate(prints.tolist()) if (x ^ y).bit_count() <= ix.radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_fingerprints():
    rng = np.random.default_rng(3)
    ids, _ = word_ids([" ".join(f"w{x}" for x in rng.integers(0, 50, 400))])
    weights = Weights(ids[:9].tolist())
    sh, w = shingle_hashes(ids), weights(ids)
    assert w.tolist() == [2 if sum(x not in set(ids[:9].tolist()) for x in ids[i : i + 5].tolist()) >= 3 else 1 for i in range(len(sh))] and set(w.tolist()) == {1, 2}
    for size, got in zip((8, 120, 140), fingerprints(sh, w, [8, 120, 140]), strict=True):
        assert len(got) == len(sh) - size + 1
        for i in (0, 7, len(got) - 1):
            sums = [sum(int(x) * (int(h) >> (63 - b) & 1) for h, x in zip(sh[i : i + size], w[i : i + size], strict=True)) for b in range(64)]
            assert int(got[i]) == int("".join("1" if s > int(w[i : i + size].sum()) // 2 else "0" for s in sums), 2)


def test_similarity_of_windows():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(2)]
    ix = Index([1], texts[:1], 12, (3, 0), (4, 2), Weights([]))
    words, _ = word_ids(texts[1:])
    for size in (12, 34):
        at, item_at = np.array([0, 3, 20]), np.array([5, 0, 20])
        got = ix.similarity(shingle_hashes(words), ix.weights(words), at, item_at, size)
        for g, i, j in zip(got, at, item_at, strict=True):
            a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (texts[1].split()[i : i + size], texts[0].split()[j : j + size]))
            assert g == pytest.approx(len(a & b) / len(a | b))


def test_recall_of_edited_items(spark):
    """Of items with one word changed in about every 60, windows of the items' own size find at least nine in ten of those that an exact comparison finds."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [say(rng.choice([34, 60, 78, 101, 130])) for _ in range(200)]
    docs, want = [], set()
    for i, x in enumerate(items):
        body, y = say(300), list(x)
        for k in range(max(1, len(y) // 60)):
            y[rng.randrange(60 * k, min(len(y), 60 * k + 60))] = "changed"
        body[100:100] = y
        docs.append(" ".join(body))
        size = size_class(len(x), 12)
        cut = lambda z, a: {tuple(z[k : k + 5]) for k in range(a, a + size - 4)}  # noqa: E731, B023
        own = [cut(x, a) for a in {0, (len(x) - size) // 2, len(x) - size}]
        if any(len(o & c) >= 0.8 * len(o | c) for o in own for c in (cut(body, a) for a in range(60, 140))):
            want.add(i)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    e = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id bigint, text string")
    got = leaked_items(d, e).collect()
    whole = {r["doc_id"] for r in got if r["window"] == size_class(len(items[r["item_id"]]), 12)}
    assert all(r["doc_id"] == r["item_id"] and r["similarity"] >= 0.8 for r in got) and len(got) >= 195
    assert whole <= want and len(want) > 100 and len(whole) >= 0.9 * len(want)


def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.choice([5, 11, 12, 13, 40, 90])) for _ in range(40)]
    docs = []
    for i in range(120):
        body = say(rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            x = rng.choice(items)
            a = rng.randrange(len(x))
            at = rng.randrange(len(body) + 1)
            body[at:at] = x[a : a + rng.choice([11, 12, 13, 30])]
        docs.append(" ".join(body))
    runs = defaultdict(set)
    for j, x in enumerate(items):
        for a in range(len(x) - 11):
            runs[tuple(x[a : a + 12])].add(j)
    want = {(i, j) for i, t in enumerate(docs) for a in range(len(t.split()) - 11) for j in runs.get(tuple(t.split()[a : a + 12]), ())}
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)] + [(0, docs[0], 0), (900, None, 0), (901, "", 0), (None, docs[1], 0)], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(j, " ".join(x).upper()) for j, x in enumerate(items)] + [(99, None), (None, docs[2])], "item_id bigint, text string")
    for block in (300, 4_000_000):
        rows = leaked_items(d, e, block_chars=block).collect()
        assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows}) and {(r["doc_id"], r["item_id"]) for r in rows if r["run_words"] >= 12} == want and want
    for r in rows:
        x, t = items[r["item_id"]], docs[r["doc_id"]].split()
        longest = max((n for a in range(len(x)) for n in range(12, len(x) - a + 1) if any(t[k : k + n] == x[a : a + n] for k in range(len(t) - n + 1))), default=0)
        assert r["run_words"] == longest
    assert leaked_items(d, e.limit(0)).count() == 0 == leaked_items(d.limit(0), e).count()


# Languages


def test_code_lengths_are_those_of_a_coder():
    counts = {"en": Counter({b"the": 9, b"then": 2, b"a": 5}), "de": Counter({b"der": 9, b"das": 4})}
    m = Model(counts, order=2)

    def length(words, word):
        tree = defaultdict(Counter)
        for x, n in words.items():
            y = b" " + x + b" "
            for i in range(1, len(y)):
                for k in range(min(2, i) + 1):
                    tree[y[i - k : i]][y[i]] += n
        y, p = b" " + word + b" ", 1.0
        for i in range(1, len(y)):
            for k in range(min(2, i), -1, -1):
                seen = tree.get(y[i - k : i])
                if seen:
                    if y[i] in seen:
                        p *= seen[y[i]] / (seen.total() + len(seen))
                        break
                    p *= len(seen) / (seen.total() + len(seen))
            else:
                p /= 256
        return -np.log2(p)

    for w in (b"the", b"der", b"thaz", b"q", "жы".encode()):
        assert np.allclose(m.cost(w), [length(counts[c], w) for c in m.codes], rtol=1e-4)
    assert Scorer(m).evidence(b"x2") == 0.0


SAMPLES = {
    "en": "the house stands near the river and every child knows that the water is cold in the morning when nobody has lit the fire yet",
    "de": "das haus steht nahe am fluss und jedes kind weiß dass das wasser am morgen kalt ist wenn noch niemand das feuer gemacht hat",
    "fr": "la maison se trouve près de la rivière et chaque enfant sait que l'eau est froide le matin quand personne n'a encore allumé le feu",
}


def made(code, n, rng):
    return " ".join(rng.choice(SAMPLES[code].split()) for _ in range(n))


def test_languages(spark):
    rng = random.Random(5)
    rows, want = [], set()
    labels = {"en": ["en", "EN", "eng", "en-GB", "English"], "de": ["de", "deu", "de-AT", " German "], "fr": ["fr", "fra", "fr_CA", "French"]}
    for i in range(150):
        code = rng.choice(list(SAMPLES))
        paras, other = [made(code, rng.randrange(40, 90), rng) for _ in range(4)], rng.choice([c for c in SAMPLES if c != code])
        if i % 5 == 0:
            k, n = rng.randrange(4), rng.choice([12, 45])
            paras[k] = rng.choice([f"% {made(other, n, rng)}", f"{paras[k]} {made(other, n, rng)}"])
            if n == 45:
                want.add((i, k + 1, other))
        label = rng.choice(labels[code])
        if i % 7 == 0:
            label = rng.choice([None, "", "und", "xx", "n/a", "ja", rng.choice(labels[other])])
            want.add((i, -1, code))
        text = "\\documentclass{article}\n\\begin{document}\n\n" + "\n\n".join(paras) + "\n\n\\begin{thebibliography}{9}" + made(other, 60, rng) + "\\end{thebibliography}"
        rows.append((i, text, label, "c"))
    rows += [(900, None, "en", "c"), (901, "", None, "c"), (902, "12 34 $x$", "de", "c"), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, confidence string").repartition(3)
    out = languages(df, sample_rows=30)
    got = out.collect()
    found = {(r["doc_id"], r["para_no"], r["lang"]) for r in got if r["lang"] and (r["para_no"] >= 0 or r["label"] != r["lang"])}
    assert found == want
    assert all(0 < r["confidence"] <= 1 for r in got if r["lang"]) and {r["doc_id"] for r in got if r["lang"] is None} == {900, 901, 902}
    assert sum(r["doc_id"] == 3 and r["para_no"] == -1 for r in got) == 2
    unlabelled = languages(df.withColumn("lang", df.lang.substr(0, 0)))
    assert unlabelled.where("lang is not null").count() == 0 and unlabelled.count() == len(rows)
    assert languages(df.limit(0)).count() == 0
    assert fit([("en", None), ("de", "12")]) is None


def test_texts_of_fewer_words_than_a_piece():
    """Among the texts that confidence is fitted on, some may have no word left, and others fewer than a piece."""
    assert pieces(np.ones((2, 3), np.float32)).shape == (0, 3) and pieces(np.zeros((0, 3), np.float32)).shape == (0, 3)
    assert pieces(np.ones((7, 3), np.float32)).tolist() == [[3.0] * 3] * 2
    rng = random.Random(6)
    rows = [(code, made(code, n, rng)) for n in (60, 60, 2, 60, 60, 60, 1) for code in SAMPLES]
    assert set(fit(rows).codes) == set(SAMPLES)
    assert fit([(code, text) for code in ("en", "de") for text in [" ".join(SAMPLES[code].split()[:2])] * 4]).temperature == 1.0


def test_sample_is_read_from_few_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", ["en", "German", None][i % 3]) for i in range(600)], "doc_id bigint, text string, lang string")
    df.repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    files, held = _files(docs, {"en": 50, "de": 20})
    assert 1 < len(files) < 6 and held["en"] >= 50 and held["de"] >= 20
    assert _files(docs, {"en": 5000}) == ([], Counter()) == _files(df, {"en": 1})
    for table in (docs, df):
        assert Counter(c for c, _ in _sample(table, 25)) == {"en": 25, "de": 25}
        assert Counter(c for c, _ in _sample(table, 1000)) == {"en": 200, "de": 200}


def test_held_out_accuracy(spark):
    """Models of one half of the labelled documents on the other half."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["code"], r["text"]) for r in _labelled(df).collect()]
    m = fit(rows[::2])
    scorer = Scorer(m)
    right = total = 0
    for code, text in rows[1::2]:
        costs = scorer.words(*word_table([body(text)])[:4])
        if len(costs):
            total += 1
            right += m.codes[int(costs.sum(axis=0).argmin())] == code
    # some labels are wrong
    assert right / total > 0.9
    # short pieces of texts that are in the language of their label: confidence is how often the language is right
    sure, hit = [], []
    for code, text in rows[1::2]:
        costs = scorer.words(*word_table([body(text)])[:4])
        if len(costs) and m.codes[int(costs.sum(axis=0).argmin())] == code:
            for c in pieces(costs):
                own = int(c.argmin())
                sure.append(_share(c, own, m.temperature))
                hit.append(m.codes[own] == code)
    sure, hit = np.array(sure), np.array(hit)
    print("temperature", m.temperature, [(len(hit[k]), round(sure[k].mean(), 3), round(hit[k].mean(), 3)) for k in (sure < 0.6, (sure >= 0.6) & (sure < 0.9), sure >= 0.9)])
    assert abs(sure.mean() - hit.mean()) < 0.03


def _labelled(df):
    from emberfold.llm.language import label_code

    return df.select(label_code().alias("code"), "text").where("code is not null and text is not null")


def test_registered_queries_against_sql(spark):
    import glob
    import os

    import duckdb

    from emberfold.llm import queries

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in queries.ORACLES.items():
        df, want = queries.QUERIES[name](spark, folder), c.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        at = [want.columns.index(x) for x in df.columns]
        assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
    assert re.fullmatch(r"(p\d_\w+,?)+", ",".join(queries.QUERIES))
