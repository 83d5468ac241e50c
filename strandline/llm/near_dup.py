"""Near-duplicate sequences: an exact set-similarity self-join with adaptive multi-match prefixes.

Each record is a set of letter shingles.  All records order their shingles by the same key (estimated document
frequency, then hash), rarest first.  Two sets of similarity ``t`` or more share at least ``m`` shingles within their
*m-prefixes*, the first ``n - ceil(t*n) + m`` shingles.

Every record lengthens its prefix by what the candidates would cost.  For each level ``m`` of ``LEVELS`` the matches
``s(m)`` of its m-prefix are added up from the frequencies; by Markov's bound at most ``s(m) / m`` records share ``m``
of them, so the level costs ``KEY_COST * keys + s(m) * (1 + CHECK_COST / m)``.  The cheapest level is taken; two
records must share as many prefix shingles as the lower of their levels says before they are verified.

Beyond the levels of single shingles stands the long level ``CLASSES + SHARED``: shingles fall into CLASSES classes by
hash, so of that many shared ones at least SHARED pairs are of one class each, and the record shows the pairs of its
prefix shingles within each class; SHARED of these must be shared before verification.  A pair of shingles is far
rarer than one, so the lists stay short as the collection grows.  A single level is open only to records whose prefix
holds no shingle of more than RARE records; records of the long level therefore also show their rare single shingles,
for partners of a single level.  Records too short for the long level, and those that can be similar to such, show all
singles.  So no pair is lost, whatever levels are picked.

Bounds: the frequency table has ``FREQ_SLOTS`` slots whatever the input is; frequencies only steer the order and the
levels, a wrong estimate costs time, never a pair.  Keys move once, packed into byte planes by ranges of their value,
and meet in the task that gets their range.  Candidates and texts are joined by sort-merge only: a checkpoint keeps
the size estimate of the plan before it, which says nothing about the rows an Arrow function makes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.graphs import connected_groups
from strandline.session import durable

FREQ_SLOTS = 1 << 20  #: slots of the frequency table that is broadcast (8 MB)
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)  #: shared single shingles that a record may ask for
CLASSES = 48  #: classes of shingles; the long level is that of CLASSES + SHARED shared shingles
SHARED = 12  #: pairs of shingles that two records of the long level must share
RARE = 8  #: a shingle of up to so many records is rare
KEY_COST, CHECK_COST = 2.0, 30.0  #: of a shown key and of a verified candidate, in matches
EXPAND_COPIES = 1000  #: classes of more equal texts stand as pairs (representative, copy), not as all pairs of copies
HOT_POSTINGS = 4000  #: posting lists above this are split over salts
CHUNK = 1 << 20  #: letters whose shingles are held at once
KEY_BITS = 40  #: of a key that are kept; two different keys that agree in them only make a candidate more
RANGE_KEYS = 250_000  #: shingles for each range of keys; a range is joined at once
MET_ROWS = 1 << 17  #: matches that are handed on at once


def normalise(col: str) -> F.Column:
    """Sequence without white space and '-', in upper case, U read as T."""
    return F.translate(F.upper(F.regexp_replace(F.col(col), r"(?U)[\s\-]+", "")), "U", "T")


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct shingles of every text, sorted by text, then hash."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    m = len(cp) - width + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[k : k + m] + np.uint64(0x2545F491)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # a sort of each text's own hashes stays in the cache; one sort of all of them doesn't
    end = np.cumsum(size)
    sets = [np.unique(h[e - n : e - width + 1]) if n >= width else h[:0] for e, n in zip(end.tolist(), size.tolist())]
    return np.concatenate(sets), np.repeat(np.arange(len(texts)), [len(x) for x in sets])


def _chunks(pdf: pd.DataFrame, letters: int = CHUNK) -> Iterator[tuple[np.ndarray, list[str]]]:
    reps, texts = pdf["rep"].to_numpy(np.int64), pdf["text"].tolist()
    part = np.cumsum([len(t) for t in texts]) // letters if texts else np.empty(0, np.int64)
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        yield reps[rows], [texts[i] for i in rows]


def _need(n: np.ndarray | int, t: float):
    """Least overlap that a set of n members needs for similarity t; the slack absorbs rounding."""
    return np.ceil(np.asarray(n) * t - 1e-9).astype(np.int64)


def _count_slots(width: int):
    """mapInPandas body: records per slot of the shingle hashes, summed over the task; slot -1 counts the records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq, n = np.zeros(FREQ_SLOTS, np.int64), 0
        for pdf in batches:
            n += len(pdf)
            for _, texts in _chunks(pdf):
                h, _ = shingle_sets(texts, width)
                freq += np.bincount((h & np.uint64(FREQ_SLOTS - 1)).astype(np.int64), minlength=FREQ_SLOTS)
        at = np.flatnonzero(freq)
        yield pd.DataFrame({"s": np.append(at, -1).astype(np.int32), "c": np.append(freq[at], n)})

    return run


class Prefixes:
    """Picks levels and shows keys for the records of a chunk."""

    def __init__(self, freq: np.ndarray, records: int, threshold: float, width: int):
        self.freq, self.records, self.t, self.width = freq, max(records, 1), threshold, width
        # read on the driver, as tests set them there
        self.classes, self.shared, self.rare, self.hot = CLASSES, SHARED, RARE, HOT_POSTINGS
        self.ranges = 1 + int(freq.sum()) // RANGE_KEYS
        self.levels = LEVELS
        self.helper = max(LEVELS) + 1  #: stands for the level of the rare singles of a record of the long level

    def keys(self, reps: np.ndarray, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(key, estimated frequency, rep, set size, level, entry) of every key shown; level 0 is the long one.

        ``entry`` is the lowest level whose prefix holds the shingle; pairs have 0.
        """
        h, of = shingle_sets(texts, self.width)
        f = self.freq[(h & np.uint64(len(self.freq) - 1)).astype(np.int64)]
        n = np.bincount(of, minlength=len(texts))
        start = np.cumsum(n) - n
        # by frequency, then hash, in each text; the hashes are sorted already and the sort is stable
        order = [s + np.argsort(f[s : s + k], kind="stable") for s, k in zip(start.tolist(), n.tolist())]
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        h, f = h[order], f[order]
        need = _need(n, self.t)
        base = n - need
        pos = np.arange(len(h)) - start[of]
        long = self.classes + self.shared
        fits = need >= long
        free = ~fits | (_need(need, self.t) < long)  # too short for the long level, or similar to such
        met = np.concatenate([[0], np.cumsum(f - 1)])  # matches up to here
        some = np.concatenate([[0], np.cumsum(f > 1)])  # keys that meet anybody
        level, best = np.zeros(len(texts), np.int64), np.full(len(texts), np.inf)
        reach = start + np.minimum(base + long, n)
        pairs = (some[reach] - some[start]).astype(float) ** 2 / (2 * self.classes)
        mean = 1 + (met[reach] - met[start]) / np.maximum(reach - start, 1)
        best = np.where(free, np.inf, pairs * (KEY_COST + mean * mean / self.records * (1 + CHECK_COST / self.shared)))
        for m in self.levels:
            end = start + np.minimum(base + m, n)
            cost = (some[end] - some[start]) * KEY_COST + (met[end] - met[start]) * (1 + CHECK_COST / m)
            last = f[np.maximum(end - 1, 0)] if len(f) else np.zeros(len(texts), np.int64)
            open_ = (m <= np.maximum(need, 1)) & (free | (last <= self.rare)) & (n > 0) & (cost < best)
            level, best = np.where(open_, m, level), np.where(open_, cost, best)
        mine = level[of]
        entry = np.maximum(pos - base[of] + 1, 1)
        single = np.where(mine > 0, entry <= mine, (entry < self.helper) & (f <= self.rare)) & (f > 1)
        out = [
            (
                h[single] * np.uint64(0x9E3779B97F4A7C15), f[single], of[single],
                np.where(mine > 0, mine, self.helper)[single].astype(np.int8), entry[single].astype(np.int8),
            )
        ]
        two = (mine == 0) & (entry <= long) & (f > 1)
        if two.any():
            h, f, of = h[two], f[two], of[two]
            group = of * self.classes + ((h >> np.uint64(20)) % np.uint64(self.classes)).astype(np.int64)
            by = np.argsort(h, kind="stable")
            by = by[np.argsort(group[by], kind="stable")]
            h, f, of, group = h[by], f[by], of[by], group[by]
            for d in range(1, len(h)):
                same = np.flatnonzero(group[d:] == group[:-d])
                if not len(same):
                    break
                key = (h[same] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[same + d] * np.uint64(0x165667B19E3779F9) + np.uint64(0x9E3779B97F4A7C15))
                zero = np.zeros(len(same), np.int8)
                out.append((key, np.minimum(f[same], f[same + d]), of[same], zero, zero))
        key, f, of, level, entry = (np.concatenate(c) for c in zip(*out))
        return key.view(np.int64), f, reps[of], n[of].astype(np.int32), level, entry

    def packed(self, reps: np.ndarray, texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
        """(range, its keys in order) of the chunk; a long list is split: its left copies are spread over salts, its right
        copies go to each of them."""
        key, f, rep, n, level, entry = self.keys(reps, texts)
        salts = -(-f // self.hot)
        at = np.repeat(np.arange(len(key)), salts)
        salt = np.arange(len(at)) - np.repeat(np.cumsum(salts) - salts, salts)
        left = rep[at] % salts[at] == salt
        tok = (key.view(np.uint64)[at] + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - KEY_BITS)
        note = n[at].astype(np.int64) << 11 | left.astype(np.int64) << 10 | entry[at].astype(np.int64) << 5 | level[at]
        by = np.argsort(tok, kind="stable")
        tok, rep, note = tok[by].astype(np.int64), rep[at][by], note[by]
        span = (1 << KEY_BITS) // self.ranges + 1
        got, start = np.unique(tok // span, return_index=True)
        step = np.diff(tok, prepend=0)
        step[start] = tok[start]
        end = [*start[1:], len(tok)]
        return got, [b"".join(_planes(c[i:j]) for c in (step, rep, note)) for i, j in zip(start, end)]

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for reps, texts in _chunks(pdf, CHUNK // 4):  # a text has several keys a letter
                ranges, packs = self.packed(reps, texts)
                yield pd.DataFrame({"range": ranges.astype(np.int32), "keys": packs})

    def met(self, tok: np.ndarray, rep: np.ndarray, note: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(left rep, right rep, shared keys needed) of every two postings of one key that may be of a similar pair."""
        by = np.argsort(tok, kind="stable")
        tok, rep, note = tok[by], rep[by], note[by]
        n, left, entry, level = note >> 11, (note >> 10 & 1).astype(bool), note >> 5 & 31, note & 31
        i, d = np.arange(len(tok) - 1), 1
        while len(i := i[tok[i + d] == tok[i]]):
            j = i + d
            turn = (n[i] > n[j]) | ((n[i] == n[j]) & (rep[i] > rep[j]))
            a, b = np.where(turn, j, i), np.where(turn, i, j)
            low = np.minimum(level[a], level[b])  # both show all shingles of that level's prefixes
            ok = left[a] & (rep[a] != rep[b]) & (n[a] >= n[b] * self.t - 1e-9) & (low < self.helper) & (np.maximum(entry[a], entry[b]) <= low)
            yield rep[a[ok]], rep[b[ok]], np.where(low[ok] == 0, self.shared, low[ok])
            d += 1
            i = i[i < len(tok) - d]

    def meet(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """mapInPandas body: matches of the packed keys; rows come sorted by range."""
        for packs in _by_range(batches):
            cols = [np.concatenate(c) for c in zip(*map(_unpacked, packs))]
            held, rows = [], 0
            for got in self.met(*cols):
                held.append(got)
                rows += len(got[0])
                if rows >= MET_ROWS:
                    yield _matches(held)
                    held, rows = [], 0
            if rows:
                yield _matches(held)


def _matches(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    x, y, least = (np.concatenate(c) for c in zip(*held))
    return pd.DataFrame({"x": x, "y": y, "least": least.astype(np.int32)})


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on; bytes that are 0 throughout compress to nothing."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(pack: bytes) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(pack, np.uint8).reshape(3, 8, -1)
    step, rep, note = (np.ascontiguousarray(c.T).view("<i8").ravel() for c in x)
    return np.cumsum(step), rep, note


def _by_range(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """The packs of one range after the other."""
    last, held = None, []
    for pdf in batches:
        for r, pack in zip(pdf["range"].tolist(), pdf["keys"]):
            if r != last and held:
                yield held
                held = []
            last = r
            held.append(pack)
    if held:
        yield held


def _verify(t: float, width: int):
    """mapInPandas body: exact similarity of candidate pairs; rows come sorted by rep_a."""

    def grams(s: str, memo: dict) -> frozenset:
        got = memo.get(s)
        if got is None:
            if len(memo) > 4096:
                memo.clear()
            got = memo[s] = frozenset([s[i : i + width] for i in range(len(s) - width + 1)])
        return got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, frozenset] = {}
        for pdf in batches:
            both, either = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for i, (a, b) in enumerate(zip(pdf["text_a"], pdf["text_b"])):
                x, y = grams(a, memo), grams(b, memo)
                both[i] = c = len(x & y)
                either[i] = len(x) + len(y) - c
            ok = both >= t * either - 1e-9
            yield pd.DataFrame({"rep_a": pdf["rep_a"][ok], "rep_b": pdf["rep_b"][ok], "both": both[ok], "either": either[ok]})

    return run


def representatives(df: DataFrame, id_col: str, text_col: str, width: int, norm=normalise) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep), (reps: rep, text): equal normalised texts form a class, its smallest id stands for it.

    Rows whose id or text is NULL, or whose text is shorter than ``width``, are in no class.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), norm(text_col).alias("text"))
    rows = rows.where((F.length("text") >= width) & F.col("id").isNotNull())
    reps = rows.groupBy("text").agg(F.min("id").alias("rep"))
    return rows.join(reps.hint("merge"), "text").select("id", "rep"), reps.select("rep", "text")


def similar_representatives(reps: DataFrame, threshold: float = 0.7, width: int = 10) -> DataFrame:
    """(rep_a, rep_b, both, either) for each pair of different texts of similarity ``threshold`` or more.

    ``reps`` holds (rep, text), texts distinct.  Empty input gives an empty result.
    """
    spark = reps.sparkSession
    slots = reps.mapInPandas(_count_slots(width), "s int, c bigint")
    counted = slots.groupBy("s").agg(F.sum("c").alias("c")).toArrow().to_pandas()  # FREQ_SLOTS + 1 rows at most
    at, c = counted["s"].to_numpy(np.int64), counted["c"].to_numpy(np.int64)
    freq = np.zeros(FREQ_SLOTS, np.int64)
    freq[at[at >= 0]] = c[at >= 0]
    picker = Prefixes(freq, int(c[at < 0].sum()), threshold, width)
    shared = spark.sparkContext.broadcast(picker)
    packs = reps.mapInPandas(lambda it: shared.value.run(it), "range int, keys binary")
    packs = packs.repartition(max(12, picker.ranges // 4), "range").sortWithinPartitions("range")
    met = packs.mapInPandas(lambda it: shared.value.meet(it), "x bigint, y bigint, least int")
    pairs = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("hits"), F.max("least").alias("least"))
    pairs = pairs.where("hits >= least").select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"))
    ta = reps.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a"))
    tb = reps.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b"))
    full = pairs.join(tb.hint("merge"), "rep_b").join(ta.hint("merge"), "rep_a").select("rep_a", "rep_b", "text_a", "text_b")
    return full.mapInPandas(_verify(threshold, width), "rep_a bigint, rep_b bigint, both bigint, either bigint")


def near_duplicate_pairs(df: DataFrame, id_col: str = "idx", text_col: str = "sequence", threshold: float = 0.7, width: int = 10) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows whose shingle sets are similar.

    Pairs of one class of equal texts are pairs too.  A class of more than EXPAND_COPIES equal texts isn't multiplied
    out, as its pairs would be the square of it: its copies pair with their representative, which alone stands for
    them in pairs with other texts; no link between different texts is lost.  ``similar_classes`` has one form for
    classes of every size.  NULL or short texts are in no pair; two rows that repeat one id make no pair with each other.
    """
    members, reps = representatives(df, id_col, text_col, width)
    members = durable(members)
    links = similar_representatives(durable(reps), threshold, width).select("rep_a", "rep_b")
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = members.join(sizes.hint("merge"), "rep", "left")
    shown = sized.where(F.col("n").isNull() | (F.col("n") <= EXPAND_COPIES) | (F.col("id") == F.col("rep"))).select("rep", "id")
    ma = shown.select(F.col("rep").alias("rep_a"), F.col("id").alias("i"))
    mb = shown.select(F.col("rep").alias("rep_b"), F.col("id").alias("j"))
    across = links.join(ma.hint("merge"), "rep_a").join(mb.hint("merge"), "rep_b").select("i", "j")
    few = sized.where(F.col("n") <= EXPAND_COPIES).select("rep", "id")
    one, other = few.withColumnRenamed("id", "i"), few.withColumnRenamed("id", "j")
    inside = one.join(other.hint("merge"), "rep").where("i < j").select("i", "j")
    star = sized.where(F.col("n") > EXPAND_COPIES).select(F.col("rep").alias("i"), F.col("id").alias("j"))
    every = across.unionByName(inside).unionByName(star)
    return every.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).where("id_a < id_b").distinct()


def similar_classes(df: DataFrame, id_col: str = "idx", text_col: str = "sequence", threshold: float = 0.7, width: int = 10) -> DataFrame:
    """(rep_a, rep_b, both, either), rep_a < rep_b: the pairs of classes of equal texts that are similar.

    ``rep`` is a class's smallest id; ``near_duplicate_groups`` lists each class's members.  NULL or short texts are
    in no class.
    """
    return similar_representatives(durable(representatives(df, id_col, text_col, width)[1]), threshold, width)


def near_duplicate_groups(df: DataFrame, id_col: str = "idx", text_col: str = "sequence", threshold: float = 0.7, width: int = 10) -> DataFrame:
    """One row per record: (id, rep, grp, copies, links).

    ``rep`` stands for the class of equal texts, ``grp`` is the smallest id of the connected group, ``copies``
    the rows of the class, ``links`` the other classes it is similar to.  Records with NULL or short text are left out.
    """
    members, reps = representatives(df, id_col, text_col, width)
    members, reps = durable(members), durable(reps)
    links = durable(similar_representatives(reps, threshold, width).select("rep_a", "rep_b"))
    groups = connected_groups(reps.select(F.col("rep").alias("node")), links.toDF("a", "b"))
    ends = links.select(F.col("rep_a").alias("rep")).union(links.select("rep_b"))
    n_links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    per_class = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    info = per_class.join(groups.withColumnRenamed("node", "rep").hint("merge"), "rep").join(n_links.hint("merge"), "rep", "left")
    return members.join(info.hint("merge"), "rep").select("id", "rep", "grp", "copies", F.coalesce("links", F.lit(0)).alias("links"))
