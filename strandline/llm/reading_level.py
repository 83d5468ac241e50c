"""Reading level: sentence classifiers on characters and words, aggregated to calibrated document difficulty.

A sentence's level is words + percentage of words over six letters, in the classes of ``SENTENCE_EDGES``.  Two linear
models of hashed features, one of character trigrams and one of words, are fitted together by multinomial logistic
regression with an L2 penalty on at most ``TRAIN_DOCS`` documents (the smallest hashes of doc_id, so the sample doesn't
depend on partitions).  Every sentence of every document is classified.  A document's sentence distribution, each
sentence weighing one and each weighing its letters, and its letters per sentence give its difficulty by a ridge
calibration to the level of the training documents.

A ``HELD`` share of the sample is held out of both fits.  Errors shrink with the fourth root of the sentences; ``SAFETY``
times the ``SURE`` quantile of error times that root, over the held-out documents, is the margin.  A difficulty
further from every band's edge than the margin over the root of its own sentences decides the document's band.  Nearer
to an edge an exact check follows: the level computed from the document's words and sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.textscan import LETTER, Scan, chunks, cut_long, plain

BANDS = (30.0, 45.0, 60.0)  #: lower ends of bands 2, 3 and 4
SENTENCE_EDGES = (10.0, 20.0, 30.0, 37.0, 45.0, 52.0, 60.0, 70.0, 80.0, 90.0, 100.0)  #: lower ends of the sentence classes
LEAST_WORDS = 30
LONG_WORD = 6
TRAIN_DOCS = 1000  #: documents the models are fitted on, at most
TRAIN_LETTERS = 700_000  #: and letters of them, at most
HELD = 0.25  #: share of them that measures the margin
SURE, SAFETY = 0.99, 1.6  #: quantile of the errors among them, and the margin over it
ROUNDS = 25
L2 = 1e-4
BITS = 14
PART = 1 << 20
_BREAK = re.compile(r"[.!?](?=\s+[^\W\d_a-z])()\s")


def band(level: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.asarray(BANDS), level, side="right") + 1


class Sentences:
    """Sentences with a word of some plain texts: their words, long words, features."""

    def __init__(self, texts: list[str], features: bool = True):
        s = Scan(texts)
        breaks = s.sentence_breaks()
        a, b = s.runs(LETTER)
        sent = np.searchsorted(breaks, a)  # breaks before the word
        kept, self.word_sent = np.unique(sent, return_inverse=True)
        self.n = len(kept)
        self.words = np.bincount(self.word_sent, minlength=self.n)
        self.long = np.bincount(self.word_sent, weights=(b - a > LONG_WORD), minlength=self.n).astype(np.int64)
        lo = breaks[kept - 1] + 1  # a break always stands before: the leading separator
        hi = breaks[kept] if self.n else lo
        self.doc = s.doc_of(lo)
        if not features or not self.n:
            return
        self.word_feat = (s.hashes(a, b) >> np.uint64(64 - BITS)).astype(np.int32)
        cp = s.cp[:-2] * np.uint32(0x01000193) ^ s.cp[1:-1] * np.uint32(0x9E3779B1) ^ s.cp[2:] * np.uint32(0x85EBCA6B)
        tri = ((cp ^ (cp >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        # trigrams from each sentence's first letter to the next one's; a stretch without words goes to the one before
        self.tri, self.lo, self.chars = tri.astype(np.int32), lo, hi - lo
        self.edges = np.minimum(np.stack([lo, np.maximum(hi - 2, lo + 1)], 1).ravel(), len(tri) - 1)


class LevelModel:
    """Weights of both models, the calibration to document difficulty, and the margin of a sure band."""

    def __init__(self):
        k = len(SENTENCE_EDGES) + 1
        self.char = np.zeros((1 << BITS, k), np.float32)
        self.word = np.zeros((1 << BITS, k), np.float32)
        self.bias = np.zeros(k, np.float32)
        self.calibration = np.zeros(2 * k + 1, np.float64)
        self.margin = np.inf

    def scores(self, x: Sentences) -> np.ndarray:
        chars = np.add.reduceat(self.char[x.tri], x.edges, axis=0)[::2] / np.maximum(x.chars, 1)[:, None].astype(np.float32)
        first = np.flatnonzero(np.diff(x.word_sent, prepend=-1))
        return self.bias + 8 * chars + np.add.reduceat(self.word[x.word_feat], first, axis=0) / 4

    def probabilities(self, x: Sentences) -> np.ndarray:
        z = self.scores(x)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, texts: list[str]) -> LevelModel:
        held = int(len(texts) * HELD)
        x = Sentences(texts[held:])
        if not x.n:
            return self
        k = len(self.bias)
        level = x.words + 100.0 * x.long / x.words
        target = np.eye(k, dtype=np.float32)[np.searchsorted(np.asarray(SENTENCE_EDGES), level, side="right")]
        span = np.maximum(x.edges[1::2] - x.edges[::2], 1)
        at = np.repeat(x.edges[::2] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        tri, of = x.tri[at], np.repeat(np.arange(x.n), span)
        weight = 8 / np.maximum(x.chars, 1)
        seen = {id(w): np.full(w.shape, 1e-6, np.float32) for w in (self.char, self.word)}
        seen_b = np.full(k, 1e-6, np.float32)
        for _ in range(ROUNDS):
            g = (self.probabilities(x) - target) / x.n
            for c in range(k):
                for w, idx, src in ((self.char, tri, (g[:, c] * weight)[of]), (self.word, x.word_feat, g[x.word_sent, c] / 4)):
                    grad = np.bincount(idx, weights=src, minlength=1 << BITS).astype(np.float32) + L2 * w[:, c]
                    acc = seen[id(w)]
                    acc[:, c] += grad * grad
                    w[:, c] -= 0.5 * grad / np.sqrt(acc[:, c])
            gb = g.sum(0)
            seen_b += gb * gb
            self.bias -= (0.5 * gb / np.sqrt(seen_b)).astype(np.float32)
        a, y, _ = self.profiles(x, len(texts) - held)
        self.calibration = np.linalg.solve(a.T @ a + 1e-3 * np.eye(a.shape[1]), a.T @ y)
        x = Sentences(texts[:held])
        if x.n:
            sums = document_sums(x, self.probabilities(x), x.doc, held)
            a, y, at = document_features(sums)
            error = np.abs(a @ self.calibration - y) * sums[at, 0] ** 0.25
            self.margin = SAFETY * float(np.quantile(error, SURE)) if len(y) else np.inf
        return self

    def profiles(self, x: Sentences, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, exact level, number) of the documents of ``LEAST_WORDS`` words or more."""
        return document_features(document_sums(x, self.probabilities(x), x.doc, n_docs))


def document_sums(x: Sentences, p: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per document: sentences, words, long words, letters, class probabilities, and those times the sentence's letters."""
    cols = [np.ones(x.n), x.words, x.long, x.chars, *p.T, *(p * x.chars[:, None]).T]
    return np.stack([np.bincount(of, weights=w, minlength=n) for w in cols], 1)


def document_features(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, exact level, number) of the documents of ``LEAST_WORDS`` words or more."""
    at = np.flatnonzero(sums[:, 1] >= LEAST_WORDS)
    s = sums[at]
    k = (s.shape[1] - 4) // 2
    features = np.concatenate([s[:, 4 : 4 + k] / s[:, :1], s[:, 4 + k :] / s[:, 3:4], s[:, 3:4] / s[:, :1]], 1)
    return features, s[:, 1] / s[:, 0] + 100.0 * s[:, 2] / s[:, 1], at


def _score(model: LevelModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(model.bias)
        for pdf in batches:
            rows, texts = [], []
            for r, t in enumerate(pdf["text"]):
                parts = cut_long(plain(t), PART, _BREAK)
                rows += [r] * len(parts)
                texts += parts
            rows, n = np.asarray(rows, np.int64), len(pdf)
            sums = np.zeros((n, 4 + 2 * k))
            for first, some in chunks(texts):
                x = Sentences(some)
                if x.n:
                    sums += document_sums(x, model.probabilities(x), rows[first + x.doc], n)
            features, level, at = document_features(sums)
            difficulty = features @ model.calibration
            by_model = band(difficulty)
            sure = np.abs(difficulty[:, None] - np.asarray(BANDS)).min(1) > model.margin / sums[at, 0] ** 0.25
            out = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at].to_numpy(), "difficulty": difficulty})
            out["shares"] = pd.Series(list(features[:, :k]), index=out.index, dtype=object)
            out["model_band"], out["sure"] = by_model.astype(np.int32), sure
            out["n_words"], out["n_sentences"] = sums[at, 1].astype(np.int64), sums[at, 0].astype(np.int64)
            out["level"] = level
            out["band"] = np.where(sure, by_model, band(level)).astype(np.int32)
            yield out

    return run


def fit_level_model(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> LevelModel:
    """The models, fitted on the ``train_docs`` documents of the smallest id hashes.  NULL texts are passed over."""
    rows = documents.where("text is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    ids = rows.select("doc_id", "h").orderBy("h", "doc_id").limit(train_docs).select("doc_id").distinct()  # train_docs at most
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").toArrow().to_pandas()
    texts, n = [], 0
    for t in sample.sort_values(["h", "doc_id", "text"])["text"]:
        if n + len(t) <= TRAIN_LETTERS:
            texts.append(plain(t))
            n += len(t)
    return LevelModel().fit(texts)


def reading_levels(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, difficulty, shares, model_band, sure, n_words, n_sentences, level, band), one row per document of 30
    words or more.

    ``shares`` is the distribution of the document's sentences over the sentence classes, ``difficulty`` its
    calibration, ``model_band`` the band of that.  ``band`` is the same where it is ``sure``, beyond the margin from
    every edge; elsewhere it is that of ``level``, the exact check.  NULL, empty and short texts give no row; repeated
    rows each give one.  Without a held-out document the check decides all.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = documents.sparkSession.sparkContext.broadcast(fit_level_model(docs, train_docs))
    schema = "doc_id bigint, difficulty double, shares array<double>, model_band int, sure boolean, n_words bigint, n_sentences bigint, level double, band int"
    return docs.where("text is not null").mapInPandas(lambda it: _score(model.value)(it), schema)
