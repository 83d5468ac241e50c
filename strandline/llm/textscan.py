"""Whole texts as arrays of code points: plain text, words, sentences, without a Python step per letter.

Texts are joined with a neutral separator and scanned in chunks of about ``CHUNK`` letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHUNK = 250_000  #: letters scanned at once; memory is about 60 bytes a letter
SEP = "\x00"

# fixed values: what the data's plain text leaves out
INVISIBLE = "​‌‍﻿­"
_TAG = re.compile(r"</?[^\W\d_][^>]*>")
_DROP = {ord(c): None for c in INVISIBLE}
_HAS = re.compile(f"[{INVISIBLE}\x00]")
_DROP[0] = " "


def plain(text: str) -> str:
    """Mark-up tags become a blank, then invisible characters vanish."""
    if "<" in text:
        last = text.rfind(">") + 1  # so that every search for the end of a tag succeeds: linear time
        if last:
            text = _TAG.sub(" ", text[:last]) + text[last:]
    return text.translate(_DROP) if _HAS.search(text) else text


LETTER, DIGIT, UPPER, SPACE = 1, 2, 4, 8


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(class bits, lower-case code point) of every code point."""
    cls = np.zeros(0x110000, np.uint8)
    low = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if 0x3400 <= i <= 0x9FFF or 0xAC00 <= i <= 0xD7A3 or 0x20000 <= i <= 0x2FA1F:
            c = chr(i)
            cls[i] = LETTER if c.isalpha() else 0
            continue
        if 0xD800 <= i <= 0xF8FF or i > 0x323AF:
            continue
        c = chr(i)
        if c.isalpha():
            cls[i] = LETTER | (UPPER if unicodedata.category(c) == "Lu" else 0)
            lo = c.lower()
            if len(lo) == 1:
                low[i] = ord(lo)
        elif c.isdecimal():
            cls[i] = DIGIT
        elif c.isspace():
            cls[i] = SPACE
    return cls, low


BASE = 0x9E3779B97F4A7C15  #: odd, so that it has an inverse modulo 2**64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    up, down = np.full(n, np.uint64(BASE)), np.full(n, np.uint64(pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about ``size`` letters."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= size):
            n += len(texts[j]) + 2
            j += 1
        yield i, texts[i:j]
        i = j


class Scan:
    """Code points of some plain texts, each followed by a separator."""

    def __init__(self, texts: list[str]):
        joined = SEP + SEP.join(texts) + SEP
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc_end = np.cumsum(sizes) + 1  # one past each text's separator
        self.n = len(texts)
        self.cls = tables()[0][self.cp]

    def runs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the maximal runs of the given classes; separators end runs."""
        edge = np.flatnonzero(np.diff((self.cls & bits) != 0)) + 1
        return edge[::2], edge[1::2]

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_end, pos, side="right")

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the lower-cased stretches [start, end)."""
        if not len(start):
            return np.empty(0, np.uint64)
        up, down = _powers(1 << max(18, int(len(self.cp) - 1).bit_length()))
        low = tables()[1][self.cp].astype(np.uint64)
        low *= low + np.uint64(0x51ED)
        low *= up[: len(low)]
        total = np.cumsum(low, dtype=np.uint64)  # the first code point is a separator: start > 0
        h = (total[end - 1] - total[start - 1]) * down[start]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64)

    def sentence_breaks(self) -> np.ndarray:
        """Positions where a sentence ends: white space after . ! or ? and before an upper-case letter, white
        space that holds a blank line, and the separators."""
        s, e = self.runs(SPACE)
        cp = self.cp
        prev, nxt = cp[s - 1], self.cls[e]
        stop = ((prev == 46) | (prev == 33) | (prev == 63)) & (nxt & UPPER != 0)
        line = np.flatnonzero((cp == 10) | (cp == 13))
        line = line[(cp[line] == 10) | (cp[line + 1] != 10)]  # a line end of two letters counts once
        blank = np.searchsorted(line, e) - np.searchsorted(line, s) >= 2
        return np.sort(np.concatenate([s[stop | blank], np.flatnonzero(cp == 0)]))


def cut_long(text: str, size: int, boundary: re.Pattern) -> list[str]:
    """A very long text in parts of about ``size`` letters, cut only where ``boundary`` matches (at its group 1)."""
    if len(text) <= 2 * size:
        return [text]
    out, at = [], 0
    while len(text) - at > 2 * size:
        m = boundary.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start(1)])
        at = m.start(1)
    return [*out, text[at:]]
