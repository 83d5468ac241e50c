"""Evaluation texts leaking into training text: pigeonhole edit matching.

A test item leaks when a run of ``run`` successive words of it stands in a document with at most ``errors`` word
edits.  Each run is split into ``errors + 1`` pieces, one of which must stand unchanged; exact hits of pieces are
looked up by fingerprint, and around each hit Myers' bit-parallel distance, over words, verifies the whole run.

All documents are read once, however many items there are.  Up to ``INDEX_ITEMS`` items of ``INDEX_LETTERS`` letters
in all, the pieces are broadcast as one sorted index.  Beyond that a bitmap of ``SLOTS`` slots, of the same size for any
number of items, passes the places of documents whose fingerprint a piece may have; these are joined to the pieces by
fingerprint and verified by the same distance.  Nothing about documents is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.textscan import CHUNK, DIGIT, LETTER, Scan, chunks, plain
from strandline.session import durable

RUN, ERRORS = 10, 1
INDEX_ITEMS, INDEX_LETTERS = 10_000, 8_000_000
SLOTS = 1 << 22  #: bits of a fingerprint's slot in the bitmap: the upper 22
PART = 1 << 20  #: letters of a part of a very long text
_GAP = re.compile(r"[^\W_]()[\W_]")


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash) of every word, in order."""
    s = Scan(texts)
    a, b = s.runs(LETTER | DIGIT)
    return s.doc_of(a), s.hashes(a, b)


def fold(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of ``width`` successive word hashes, for each start."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return out ^ (out >> np.uint64(32))


def slot(fp: np.ndarray) -> np.ndarray:
    return (fp >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern row to any stretch of its text row (bit-parallel, a bit per word)."""
    n, m = pattern.shape
    one = np.int64(1)
    pv = np.full(n, (1 << m) - 1, np.int64)
    mv = np.zeros(n, np.int64)
    full, high = np.int64((1 << m) - 1), np.int64(1 << (m - 1))
    score = np.full(n, m, np.int64)
    best = score.copy()
    for j in range(text.shape[1]):
        eq = np.zeros(n, np.int64)
        for i in range(m):
            eq |= (pattern[:, i] == text[:, j]).astype(np.int64) << i
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score = score + ((ph & high) != 0) - ((mh & high) != 0)
        ph, mh = ph << one, mh << one  # no charge for starting anywhere in the text
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        best = np.minimum(best, score)
    return best


class PieceIndex:
    """The pieces of a block of items by fingerprint."""

    def __init__(self, ids: np.ndarray, texts: list[str], run: int, errors: int):
        self.run, self.errors, self.ids = run, errors, np.asarray(ids, np.int64)
        item, self.words = words_of([plain(t) for t in texts]) if texts else (np.empty(0, np.int64), np.empty(0, np.uint64))
        self.item, self.first = item, np.searchsorted(item, item)  # of every word: its item, and that item's first word
        cut = np.linspace(0, run, errors + 2).astype(int)
        self.widths = sorted(set(np.diff(cut).tolist()))
        start = np.arange(max(0, len(item) - run + 1))
        start = start[item[start] == item[start + run - 1]] if len(start) else start
        fp, at, off, wd = [], [], [], []
        for a, b in zip(cut[:-1], cut[1:]):
            f = fold(self.words, b - a)
            fp.append(f[start + a] if len(start) else f[:0])
            at.append(start)
            off.append(np.full(len(start), a))
            wd.append(np.full(len(start), b - a))
        fp, at, off, wd = (np.concatenate(x) for x in (fp, at, off, wd))
        order = np.argsort(fp, kind="stable")
        self.fp, self.at, self.off, self.wd = fp[order], at[order], off[order], wd[order]
        self.seen = np.zeros(SLOTS, bool)
        self.seen[slot(self.fp)] = True

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item id, distance, run's first word in its item) of the runs that stand in the texts."""
        doc, h = words_of(texts)
        none = (np.empty(0, np.int64),) * 4
        if not len(h) or not len(self.fp):
            return none
        got = []
        for width in self.widths:
            f = fold(h, width)
            pos = np.flatnonzero(self.seen[slot(f)])
            f = f[pos]
            lo, hi = np.searchsorted(self.fp, f, "left"), np.searchsorted(self.fp, f, "right")
            n = hi - lo
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            pos = np.repeat(pos, n)
            k = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            same = self.wd[k] == width
            got.append((pos[same] - self.off[k[same]], self.at[k[same]], doc[pos[same]]))
        where, start, d = (np.concatenate(x) for x in zip(*got))
        if not len(where):
            return none
        # one candidate per alignment: two hit pieces of one run at one place are the same
        key = np.unique(np.stack([where, start, d]), axis=1)
        out = []
        e, run = self.errors, self.run
        for i in range(0, key.shape[1], 100_000):
            where, start, d = key[:, i : i + 100_000]
            cols = where[:, None] + np.arange(-e, run + e)[None, :]
            inside = (cols >= 0) & (cols < len(h))
            cols = np.clip(cols, 0, len(h) - 1)
            text = np.where(inside & (doc[cols] == d[:, None]), h[cols], np.uint64(0))
            dist = myers(self.words[start[:, None] + np.arange(run)[None, :]], text)
            ok = dist <= e
            out.append((d[ok], self.ids[self.item[start[ok]]], dist[ok], start[ok] - self.first[start[ok]]))
        return tuple(np.concatenate(c) for c in zip(*out))


def _doc_chunks(pdf: pd.DataFrame, reach: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(doc_id per text, plain texts) of a batch, very long texts in parts that share ``reach`` words."""
    rows, texts = [], []
    for r, t in enumerate(pdf["text"]):
        parts = parts_of(plain(t), reach)
        rows += [r] * len(parts)
        texts += parts
    ids = pdf["doc_id"].to_numpy()[np.asarray(rows, np.int64)]
    for first, some in chunks(texts, CHUNK):
        yield ids[first : first + len(some)], some


def _scan(index: PieceIndex):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = []
            for ids, some in _doc_chunks(pdf, index.run + index.errors):
                d, item, dist, at = index.hits(some)
                if len(d):
                    hits.append((ids[d], item, dist, at))
            if hits:
                found = pd.DataFrame(dict(zip(("doc_id", "item_id", "dist", "at"), (np.concatenate(c) for c in zip(*hits)))))
                best = found.groupby(["doc_id", "item_id"], as_index=False).agg(dist=("dist", "min"), runs=("at", "nunique"))
                yield best.astype({"dist": "int32", "runs": "int32"})

    return run


def _piece_rows(run: int, errors: int):
    """mapInPandas body: every piece of the items with its run's words."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, some in chunks(pdf["text"].tolist(), CHUNK):
                x = PieceIndex(pdf["item_id"].to_numpy()[first : first + len(some)], some, run, errors)
                if not len(x.fp):
                    continue
                item = x.item[x.at]
                words = x.words[x.at[:, None] + np.arange(run)].view(np.int64)
                yield pd.DataFrame(
                    {
                        "fp": x.fp.view(np.int64), "wd": x.wd.astype(np.int32), "off": x.off.astype(np.int32), "item_id": x.ids[item],
                        "at": (x.at - x.first[x.at]).astype(np.int32), "words": pd.Series(list(words), dtype=object),
                    }
                )

    return body


def _slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = np.zeros(SLOTS, bool)
    for pdf in batches:
        seen[slot(pdf["fp"].to_numpy(np.int64).view(np.uint64))] = True
    yield pd.DataFrame({"s": np.flatnonzero(seen).astype(np.int32)})


def _places(seen: np.ndarray, run: int, errors: int):
    """mapInPandas body: the places of documents that pass the bitmap, with the words any run over them can reach."""
    cut = np.linspace(0, run, errors + 2).astype(int)
    widths, back = sorted(set(np.diff(cut).tolist())), int(cut[-2]) + errors

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, some in _doc_chunks(pdf, run + errors):
                doc, h = words_of(some)
                for width in widths:
                    f = fold(h, width)
                    pos = np.flatnonzero(seen[slot(f)])
                    pos = pos[doc[pos] == doc[pos + width - 1]]
                    if not len(pos):
                        continue
                    cols = pos[:, None] - back + np.arange(back + run + errors)
                    near = np.clip(cols, 0, len(h) - 1)
                    inside = (cols >= 0) & (cols < len(h)) & (doc[near] == doc[pos][:, None])
                    win = np.where(inside, h[near], np.uint64(0)).view(np.int64)
                    yield pd.DataFrame({"fp": f[pos].view(np.int64), "wd": np.int32(width), "doc_id": ids[doc[pos]], "win": pd.Series(list(win), dtype=object)})

    return body


def _verify(run: int, errors: int):
    back = int(np.linspace(0, run, errors + 2).astype(int)[-2]) + errors

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            words = np.stack(pdf["words"].to_list()).view(np.uint64)
            first = back - errors - pdf["off"].to_numpy(np.int64)
            text = np.take_along_axis(np.stack(pdf["win"].to_list()).view(np.uint64), first[:, None] + np.arange(run + 2 * errors), 1)
            dist = myers(words, text)
            ok = dist <= errors
            yield pd.DataFrame({"doc_id": pdf["doc_id"][ok], "item_id": pdf["item_id"][ok], "dist": dist[ok].astype(np.int32), "at": pdf["at"][ok]})

    return body


def _joined(docs: DataFrame, q: DataFrame, run: int, errors: int) -> DataFrame:
    """Leaks by a join of places and pieces, for items of any number."""
    pieces = durable(q.mapInPandas(_piece_rows(run, errors), "fp bigint, wd int, off int, item_id bigint, at int, words array<bigint>"))
    slots = pieces.select("fp").mapInPandas(_slots_of, "s int").distinct().toArrow().column("s").to_numpy()  # SLOTS rows at most
    seen = np.zeros(SLOTS, bool)
    seen[slots] = True
    bits = docs.sparkSession.sparkContext.broadcast(seen)
    places = docs.mapInPandas(lambda it: _places(bits.value, run, errors)(it), "fp bigint, wd int, doc_id bigint, win array<bigint>")
    met = places.join(pieces.hint("merge"), ["fp", "wd"]).select("doc_id", "item_id", "at", "off", "words", "win")
    found = met.mapInPandas(_verify(run, errors), "doc_id bigint, item_id bigint, dist int, at int")
    best = found.groupBy("doc_id", "item_id", "at").agg(F.min("dist").alias("dist"))
    return best.groupBy("doc_id", "item_id").agg(F.min("dist").alias("dist"), F.count(F.lit(1)).cast("int").alias("runs"))


def parts_of(text: str, reach: int) -> list[str]:
    """A very long text in parts that share ``reach`` words, so that no run is lost at a cut."""
    if len(text) <= 2 * PART:
        return [text]
    word = re.compile(r"[^\W_]+")
    out, at = [], 0
    while len(text) - at > 2 * PART:
        m = _GAP.search(text, at + PART)
        if not m:
            break
        cut = m.start(1)
        out.append(text[at:cut])
        back = [w.start() for w in word.finditer(text, max(at, cut - 64 * reach), cut)][-reach:]
        if len(back) < reach:  # long words: look further
            back = [w.start() for w in word.finditer(text, at, cut)][-reach:]
        at = back[0] if back and back[0] > at else cut
    return [*out, text[at:]]


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, errors: int = ERRORS) -> DataFrame:
    """(doc_id, item_id, dist, runs): documents that hold a run of an item, the least distance and the number of
    different runs found.

    NULL texts and ids are left out; texts and items of fewer words than ``run`` give nothing.  Repeated documents
    and items each count; rows that repeat both ids are merged.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    q = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null and item_id is not null")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("s")).first()
    if size["n"] > INDEX_ITEMS or size["s"] > INDEX_LETTERS:
        return _joined(docs, q, run, errors)
    block = q.toArrow().to_pandas()
    index = spark.sparkContext.broadcast(PieceIndex(block["item_id"].to_numpy(), block["text"].tolist(), run, errors))
    found = docs.mapInPandas(lambda it: _scan(index.value)(it), "doc_id bigint, item_id bigint, dist int, runs int")
    return found.groupBy("doc_id", "item_id").agg(F.min("dist").alias("dist"), F.max("runs").alias("runs"))
