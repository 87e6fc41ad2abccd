"""Language of documents and of the mixed-language parts of them, by prediction by partial matching.

Each language has a tree of byte contexts of variable order, fitted on a bounded sample of labelled documents and then
frozen. The code length of a word under a language is what an arithmetic coder would spend on its bytes: at each byte the longest
known context codes it or pays its escape and hands over to the next shorter one, down to all 256 bytes alike. A document's
language is that of the shortest code; inside a paragraph, the cheapest way through all languages under a price for each change shows the parts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tex import _COMMAND, _OTHER, plain, word_table

#: The languages, each with the names and codes that labels may use, region aside.
LANGUAGES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
}
CODES = list(LANGUAGES)
ORDER = 5

_PARA = "\x01"
_BIBLIOGRAPHY = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", re.S)
_MATH_NAMES = "equation|align|alignat|gather|multline|eqnarray|displaymath|math"
# what a formula holds stops before another begins, so that one that isn't closed costs no more than the way to the next
_IN_MATH = rf"(?:(?!\\begin\{{(?:{_MATH_NAMES})\*?\}}|\\[(\[])[^{_PARA}])*?"
_MATH = re.compile(rf"\\begin\{{({_MATH_NAMES})\*?\}}{_IN_MATH}\\end\{{\1\*?\}}|\\\({_IN_MATH}\\\)|\\\[{_IN_MATH}\\\]|(?<!\\)\$\$?[^${_PARA}]*\$\$?")
_UNREAD = re.compile(
    r"\\(?:label|(?:eq|page|auto)?ref|input|include|includegraphics|begin|end|bibliography|bibliographystyle|usepackage|documentclass)\*?(?:\[[^\]]*\])?\{[^{}]*\}"
)


def body(text: str | None) -> bytes:
    """The readable text in lower case, paragraphs parted by the byte 1; preamble and bibliography leave only their paragraphs' marks. Commented text
    stays, formulas and the arguments of labels, files and environments go.
    """
    if not text:
        return b""
    text = text.replace(_PARA, " ").replace("\n\n", _PARA)
    if "\\" in text:
        begin = text.find("\\begin{document}")
        if begin < 0 and text.lstrip().startswith("\\documentclass"):
            begin = len(text)
        if begin > 0:
            text = _PARA * text.count(_PARA, 0, begin) + text[begin:]
        if "{thebibliography}" in text:
            text = _BIBLIOGRAPHY.sub(lambda m: _PARA * m[0].count(_PARA), text)
        text = _UNREAD.sub(" ", _MATH.sub(" ", text))
        text = _COMMAND.sub(" ", plain(text))
    elif "$" in text:
        text = plain(_MATH.sub(" ", text))
    else:
        text = plain(text)
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return text.encode("utf-8", "replace")


def label_code() -> Column:
    """The language that the column ``lang`` names, null if it names none."""
    name = F.lower(F.trim("lang"))
    short = F.regexp_extract(name, r"^([^-_]*)", 1)
    pairs = [(x, c) for c, names in LANGUAGES.items() for x in names.split()]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for c in CODES:
        out = out.when(short.isin([x for x, own in pairs if own == c]), F.lit(c))
    return out


class Model:
    """The frozen trees of all languages, merged: code lengths of every known context with its next byte, and escape lengths of every context."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER) -> None:
        self.order, self.codes, self.temperature = order, [c for c in CODES if counts.get(c)], 1.0
        trees = []
        for c in self.codes:
            tree: dict[bytes, Counter] = defaultdict(Counter)
            for word, n in counts[c].items():
                w = b" " + word + b" "
                for i in range(1, len(w)):
                    for k in range(min(order, i) + 1):
                        tree[w[i - k : i]][w[i]] += n
            trees.append({ctx: (next_, sum(next_.values()) + len(next_), len(next_)) for ctx, next_ in tree.items()})
        contexts = sorted({c for t in trees for c in t}, key=len)
        escapes = {c: np.array([math.log2(t[c][1] / t[c][2]) if c in t else 0.0 for t in trees], np.float32) for c in contexts}
        self.rows: dict[bytes, int] = {}
        table: list[np.ndarray] = []
        for c in contexts:
            for s in {s for t in trees if c in t for s in t[c][0]}:
                g = c + bytes((s,))
                shorter = table[self.rows[g[1:]]] if c else np.full(len(trees), 8.0, np.float32)
                own = escapes[c] + shorter
                for i, t in enumerate(trees):
                    if c in t and (n := t[c][0].get(s)):
                        own[i] = math.log2(t[c][1] / n)
                self.rows[g] = len(table)
                table.append(own)
        self.escape_rows = {}
        for c in contexts:
            self.escape_rows[c] = len(table)
            table.append(escapes[c])
        self.unknown = len(table)
        self.table = np.stack([*table, np.full(len(trees), 8.0, np.float32)])

    def cost(self, word: bytes) -> np.ndarray:
        """The bits that each language's coder spends on ``word`` and the space after it."""
        w, used = b" " + word + b" ", []
        rows, escapes, order = self.rows, self.escape_rows, self.order
        for i in range(1, len(w)):
            lo = i - order if i > order else 0
            while True:
                if (r := rows.get(w[lo : i + 1])) is not None:
                    used.append(r)
                    break
                if (e := escapes.get(w[lo:i])) is not None:
                    used.append(e)
                if lo == i:
                    used.append(self.unknown)
                    break
                lo += 1
        return self.table[used].sum(axis=0)


#: Of how many bits a byte a word is strange, and how many bits at most one word can speak for a language.
STRANGE, MOST = math.inf, 12.0


class Scorer:
    """Code lengths of words, each distinct word coded once while it is kept.

    A number is in no language and costs nothing. A word that even the best tree codes in more than ``strange`` bits a byte is one that no tree knows,
    such as a name; it is as dear in every language. Of any word, no language is more than ``most`` bits dearer than the best, so that no single word
    decides. With both infinite, code lengths are those of the coder.
    """

    def __init__(self, model: Model, strange: float = STRANGE, most: float = MOST, keep: int = 200_000) -> None:
        self.model, self.strange, self.most, self.keep, self.known = model, strange, most, keep, {}
        self.costs = np.empty((1024, len(model.codes)), np.float32)

    def evidence(self, word: bytes) -> np.ndarray | float:
        if any(48 <= x <= 57 for x in word):
            return 0.0
        cost = self.model.cost(word)
        best = cost.min()
        return np.full_like(cost, best) if best > self.strange * (len(word) + 1) else np.minimum(cost, best + self.most)

    def words(self, whole: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.keep:
            self.known = {}
        if len(self.known) + len(distinct) > len(self.costs):
            self.costs = np.resize(self.costs, (2 * (len(self.known) + len(distinct)), self.costs.shape[1]))
        known, costs, out = self.known, self.costs, np.empty(len(distinct), np.int64)
        for i, h in enumerate(distinct.tolist()):
            if (r := known.get(h)) is None:
                word = whole[start[first[i]] : end[first[i]]].tobytes()
                r = known[h] = len(known)
                costs[r] = self.evidence(word)
            out[i] = r
        return costs[out[at]]


def _path(costs: np.ndarray, change: float) -> np.ndarray:
    """The language of each word on the cheapest way through ``costs``, where each change of language costs ``change`` bits."""
    n, k = costs.shape
    back = np.empty((n, k), np.int8)
    best = costs[0].astype(np.float64)
    for i in range(1, n):
        low = int(best.argmin())
        jump = best[low] + change
        moved = best > jump
        back[i] = np.where(moved, low, np.arange(k))
        best = np.minimum(best, jump) + costs[i]
    out = np.empty(n, np.int64)
    out[-1] = best.argmin()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _share(costs: np.ndarray, code: int, temperature: float = 1.0) -> float:
    """What ``code`` holds of the probability of a text with these code lengths over ``temperature``, all languages alike before."""
    return float(1 / np.exp2(np.clip((costs[code] - costs) / temperature, -1000, 1000)).sum())


#: The words of the pieces that confidence is fitted on: so few that languages are mistaken for each other now and then.
PIECE = 3


def pieces(costs: np.ndarray) -> np.ndarray:
    """The code lengths of runs of ``PIECE`` words that have evidence."""
    own = costs[costs[:, 0] > 0]
    n = len(own) // PIECE
    # numpy can't tell a size given as -1 where no piece is left
    return own[: n * PIECE].reshape(n, PIECE, costs.shape[1]).sum(axis=1)


def fitted_temperature(costs: np.ndarray, own: np.ndarray) -> float:
    """The temperature under which the languages ``own`` of pieces that no tree was fitted on are most likely; 1 without pieces."""
    if not len(costs):
        return 1.0
    behind = (costs - costs[np.arange(len(own)), own][:, None]).astype(np.float64)
    return min((float(np.logaddexp2.reduce(-behind / t, axis=1).sum()), t) for t in np.geomspace(0.5, 16, 41).tolist())[1]


def segments(costs: np.ndarray, counted: np.ndarray, para: np.ndarray, main: np.ndarray, change: float, least: int, temperature: float = 1.0) -> Iterator[tuple[int, int, float, int]]:
    """``paragraph, language, confidence, words`` of each part of at least ``least`` words in another language than ``main``, which is given for each
    word.

    ``para`` numbers the paragraphs of all texts, ascending. The dear way through all languages is taken only in paragraphs where some part costs at
    least ``change`` bits less in one language than in the main one; elsewhere the cheapest way stays in the main language.
    """
    if not len(costs):
        return
    gain = np.take_along_axis(costs, main[:, None], axis=1) - costs
    first = np.flatnonzero(np.append(True, para[1:] != para[:-1]))
    # what a part can save is at most the sum of the positive gains of its paragraph
    may = np.flatnonzero((np.add.reduceat(np.maximum(gain, 0), first, axis=0) > change).any(axis=1))
    last = np.append(first[1:], len(para))
    for p in may.tolist():
        lo, hi = first[p], last[p]
        after = np.cumsum(gain[lo:hi], axis=0, dtype=np.float64)
        if not (after - np.minimum.accumulate(np.minimum(after - gain[lo:hi], after), axis=0) > change).any():
            continue
        own = costs[lo:hi]
        way = _path(own, change)
        cut = np.flatnonzero(np.append(True, way[1:] != way[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(way)), strict=True):
            n = int(counted[lo + a : lo + b].sum())
            if way[a] != main[lo] and n >= least:
                yield int(para[lo]), int(way[a]), _share(own[a:b].sum(axis=0), int(way[a]), temperature), n


#: The files among which a sample is looked for before the whole table is.
_FILES = 64


def _sample(docs: DataFrame, rows: int) -> list[tuple[str, str]]:
    """At most ``rows`` labelled texts a language, those with the lowest hashes of their ids in the fewest files, by the hash of their names, that
    hold so many of each language, else in all. Ids are chosen before any text is read, so only texts of these files are read.
    """
    labelled = docs.select("doc_id", label_code().alias("code"), F.xxhash64("doc_id").alias("h")).where("code is not null")
    sizes = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    files, held = _files(docs, {c: min(n, 2 * rows) for c, n in sizes.items()})
    own = docs
    if files:
        own = docs.where(F.col("_metadata.file_path").isin(files))
        labelled = own.select("doc_id", label_code().alias("code"), F.xxhash64("doc_id").alias("h")).where("code is not null")
    # about 3 * rows a language pass the threshold, which bounds what is ranked
    near = F.lit(False)
    for c, n in (held if files else sizes).items():
        share = min(1.0, 3 * rows / n)
        near = near | ((F.col("code") == c) & (F.pmod("h", F.lit(1_000_000_007)) <= int(share * 1_000_000_007)))
    rank = F.expr("row_number() over (partition by code order by pmod(h, 1000000007), doc_id)")
    chosen = labelled.where(near).withColumn("__r", rank).where(F.col("__r") <= rows).select("doc_id", "code")
    texts = own.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return [(r["code"], r["text"]) for r in texts.select("code", "text").collect()]


def _files(docs: DataFrame, wanted: dict[str, int]) -> tuple[list[str], Counter]:
    """The fewest of the first ``_FILES`` files with ``wanted`` labelled rows of each language, and how many they have; none if these don't hold so
    many, or if rows aren't from files.
    """
    if "_metadata" not in docs._jdf.queryExecution().analyzed().metadataOutput().toString():
        return [], Counter()
    rows = docs.select(F.col("_metadata.file_path").alias("f"), label_code().alias("code")).where("code is not null")
    by_file = rows.groupBy("f").pivot("code", sorted(wanted)).agg(F.count(F.lit(1)))
    held, files = Counter(), []
    for r in by_file.orderBy(F.xxhash64(F.regexp_extract("f", "[^/]*$", 0)), "f").limit(_FILES).collect():
        files.append(r["f"])
        held.update({c: r[c] or 0 for c in wanted})
        if all(held[c] >= n for c, n in wanted.items()):
            return files, held
    return [], Counter()


def fit(sample: list[tuple[str, str]], strange: float = STRANGE, most: float = MOST, least_texts: int = 4) -> Model | None:
    """The model of a sample of labelled texts, of the words without digits that stand in at least ``least_texts`` of them. It is fitted twice, the
    second time without the texts that the first fit gives another language, as labels may be wrong, and without their paragraphs in another
    language.
    """
    tables = []
    for code, text in sample:
        whole, hashes, start, end, _ = word_table([body(text)])
        mark = np.cumsum(whole == 1)
        tables.append((code, whole, hashes, start, end, mark[start]))

    def counted(keep: list[np.ndarray | None]) -> dict[str, Counter]:
        counts, held = defaultdict(Counter), defaultdict(Counter)
        for (code, whole, _, start, end, _), own in zip(tables, keep, strict=True):
            if own is not None:
                raw = whole.tobytes()
                words = Counter(w for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True) if not re.search(rb"[0-9]", w := raw[a:b]))
                counts[code].update(words)
                held[code].update(words.keys())
        # a word of hardly any text tells more of that text, or of its copies, than of the language
        return {c: Counter({w: n for w, n in x.items() if held[c][w] >= least_texts}) or x for c, x in counts.items()}

    everything = [np.ones(len(t[3]), bool) for t in tables]
    counts = counted(everything)
    if not any(counts.values()):
        return None
    scorer = Scorer(Model(counts), strange, most)
    keep: list[np.ndarray | None] = []
    for code, whole, hashes, start, end, para in tables:
        costs = scorer.words(whole, hashes, start, end)
        own = scorer.model.codes.index(code) if code in scorer.model.codes else -1
        if not len(costs) or costs.sum(axis=0).argmin() != own:
            keep.append(None)
            continue
        first = np.flatnonzero(np.append(True, para[1:] != para[:-1]))
        right = np.add.reduceat(costs, first, axis=0).argmin(axis=1) == own
        keep.append(np.repeat(right, np.diff(np.append(first, len(para)))))
    again = counted(keep)
    model = Model(again) if any(again.values()) else scorer.model
    # confidence is fitted on one half of the texts, by trees of the other
    half = counted([k if i % 2 else None for i, k in enumerate(keep)])
    if any(half.values()):
        judge = Scorer(Model(half), strange, most)
        held = [(pieces(judge.words(*t[1:5])[keep[i]]), judge.model.codes.index(t[0])) for i, t in enumerate(tables) if i % 2 == 0 and keep[i] is not None and t[0] in judge.model.codes]
        if held:
            model.temperature = fitted_temperature(np.concatenate([c for c, _ in held]), np.repeat([own for _, own in held], [len(c) for c, _ in held]))
    return model


_OUT = "doc_id bigint, para_no int, lang string, confidence double, words bigint, label string"


def languages(
    docs: DataFrame, *, sample_rows: int = 64, change: float = 30.0, least: int = 25, strange: float = STRANGE, most: float = MOST,
    least_texts: int = 4
) -> DataFrame:
    """``doc_id, para_no, lang, confidence, words, label``: a row with ``para_no`` -1 for each document, and one for each part of ``least`` or more
    words in another language, with its paragraph's place.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; ``label`` is the language that ``lang`` names, null if none. ``sample_rows`` bounds the labelled
    rows a language that the trees are fitted on, of whose words those in ``least_texts`` texts count; ``strange`` and ``most`` are those of
    :class:`Scorer`. A change of language inside a paragraph must save ``change`` bits. A document without words, or where no row is labelled at all,
    has a null language and confidence 0. Repeated rows give repeated results; an empty table gives none.
    """
    model = fit(_sample(docs, sample_rows), strange, most, least_texts)
    corpus = docs.select(F.col("doc_id").cast("bigint"), "text", label_code().alias("label"))
    if model is None:
        return corpus.selectExpr("doc_id", "-1 as para_no", "cast(null as string) as lang", "0.0D as confidence", "0L as words", "label")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, strange, most)
        codes = scorer.model.codes
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                ids, labels = part.column(0).to_pylist(), part.column(2).to_pylist()
                texts = [body(t) for t in part.column(1).to_pylist()]
                whole, hashes, start, end, place = word_table(texts)
                costs = scorer.words(whole, hashes, start, end)
                counted = costs[:, 0] > 0
                mark = np.cumsum(whole == 1)[start] if len(start) else start
                edges = np.searchsorted(place, np.arange(part.num_rows + 1))
                rows = []
                before = np.cumsum([0, *(t.count(1) for t in texts)])
                total, main = np.zeros((part.num_rows, costs.shape[1])), np.zeros(part.num_rows, np.int64)
                full = np.flatnonzero(edges[1:] > edges[:-1])
                if len(full):
                    total[full] = np.add.reduceat(costs.astype(np.float64), edges[full], axis=0)
                    main = total.argmin(axis=1)
                for i in range(part.num_rows):
                    n = int(counted[edges[i] : edges[i + 1]].sum())
                    rows.append((ids[i], -1, codes[main[i]], _share(total[i], int(main[i]), scorer.model.temperature), n, labels[i]) if n else (ids[i], -1, None, 0.0, 0, labels[i]))
                # the mark before each text's first byte makes its paragraphs differ from those of the text before
                for p, c, conf, n in segments(costs, counted, mark + place, main[place], change, least, scorer.model.temperature):
                    i = int(np.searchsorted(before + np.arange(len(before)), p, "right")) - 1
                    rows.append((ids[i], int(p - before[i] - i), codes[c], conf, n, labels[i]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.string()))],
                    names=["doc_id", "para_no", "lang", "confidence", "words", "label"]
                )

    return corpus.mapInArrow(run, _OUT)
