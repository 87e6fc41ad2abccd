"""Words of articles in typesetting markup."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Fixed values of the markup: accent commands with their combining characters, and letters that have commands of their own.
_ACCENTS = {
    "`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331",
}
_LETTERS = {
    "ss": "ß", "ae": "æ", "oe": "œ", "aa": "å", "o": "ø", "l": "ł", "i": "i", "j": "j", "AE": "Æ", "OE": "Œ", "AA": "Å", "O": "Ø", "L": "Ł",
    "dh": "ð", "th": "þ", "dj": "đ", "ng": "ŋ"
}

_base = r"(?:\{\s*\\?([^\W\d_])\s*\}|\s*\\([ij])(?![A-Za-z])|{bare}([^\W\d_]))"
_sign = r"\\([`'^~\"=.])\s*" + _base.replace("{bare}", "")
_named = r"\\([uvHckrdb])" + _base.replace("{bare}", r"\s+")
_ACCENT = re.compile(rf"\{{\s*(?:{_sign}|{_named})\s*\}}|{_sign}|{_named}")
_OWN = "|".join(sorted(_LETTERS, key=len, reverse=True))
_LETTER = re.compile(rf"\{{\s*\\({_OWN})\s*\}}|\\({_OWN})(?:\{{\}}|(?![A-Za-z])\s*)")
_EOL_HYPHEN = re.compile(r"-[ \t]*\r?\n[ \t%]*(?=\w)")
_CITE = re.compile(r"\\[A-Za-z]*cite[A-Za-z]*\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}")
_COMMAND = re.compile(r"\\(?:[A-Za-z@]+\*?|.)", re.S)
_OTHER = re.compile(r"[^\w\x00-\x7f]")
_ANY_ACCENT = re.compile(r"\\(?:[`'^~\"=.]|[uvHckrdb][{\s])")
_ANY_LETTER = re.compile(rf"\\(?:{_OWN})(?![A-Za-z])")


def _accented(m: re.Match) -> str:
    g = [x for x in m.groups() if x is not None]
    return unicodedata.normalize("NFC", g[1] + _ACCENTS[g[0]])


def plain(text: str) -> str:
    """``text`` with accents as letters, words joined that the end of a line divides, and without citations; other markup stays."""
    if "\\" in text:
        if "\\-" in text:
            text = text.replace("\\-", "")
        if _ANY_ACCENT.search(text):
            text = _ACCENT.sub(_accented, text)
        if _ANY_LETTER.search(text):
            text = _LETTER.sub(lambda m: _LETTERS[m[1] or m[2]], text)
        text = _CITE.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _EOL_HYPHEN.sub("", text) if "-\n" in text or "- " in text or "-\r" in text or "-\t" in text else text


def bare(text: str | None) -> bytes:
    """The words of ``text`` in lower case, as UTF-8 in which they are the runs of ASCII letters and digits and of bytes above 127.

    Words are runs of letters and digits. Commands count for nothing, their arguments and commented text stay, citations are dropped whole. A null
    text has none.
    """
    if not text:
        return b""
    text = plain(text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return text.encode("utf-8", "replace")


_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_PIECE = 1 << 18
#: The most bytes or characters whose hashes come from one running sum.
MOST_TOGETHER = 4 * _PIECE
_ODD = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(MOST_TOGETHER, _ODD, np.uint64))), dtype=np.uint64)
INVERSE = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(MOST_TOGETHER, pow(_ODD, -1, 1 << 64), np.uint64))), dtype=np.uint64)
_VALUES = np.where(
    _IN_WORD,
    (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) >> np.uint64(17)),
    np.uint64(0)
)


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts from :func:`bare`: all bytes, and for each word its 64-bit hash, its first byte, its end and the place of its text.

    The hash of a word is a polynomial in its bytes, taken from running sums, so it costs the same for short and long words.
    """
    whole = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    inside = _IN_WORD[whole]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    hashes = np.empty(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):  # pieces keep the running sums short, however long a text is
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _PIECE, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        if b - a > MOST_TOGETHER:  # one word longer than a piece
            hashes[lo] = np.uint64(hash_bytes(whole[a:b].tobytes()))
        else:
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_VALUES[whole[a:b]] * POWERS[: b - a], out=sums[1:])
            hashes[lo:hi] = (sums[end[lo:hi] - a] - sums[start[lo:hi] - a]) * INVERSE[start[lo:hi] - a]
        lo = hi
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    place = np.searchsorted(np.cumsum(size), start, "right")
    hashes ^= hashes >> np.uint64(32)
    return whole, hashes * np.uint64(0xBF58476D1CE4E5B9), start, end, place


def hash_bytes(word: bytes) -> int:
    h, mask = 0, (1 << 64) - 1
    for x in reversed(word):
        h = (h * _ODD + int(_VALUES[x])) & mask
    return h
