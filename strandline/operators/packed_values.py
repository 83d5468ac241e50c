"""Several values packed in one field: dictionary-guided segmentation.

A field is a string of pieces between separator marks.  A multi-pattern automaton over the known whole
values finds where they stand in the field; a dynamic programme over the marks picks the cover with the
fewest violations, then the most letters covered by known values, then the fewest pieces.  A violation
is a cut at a mark inside quotes or round brackets, or a bare mark inside a piece that is no known value.
So a known value keeps the marks inside it, in quotes or not, and no other bare mark is passed over.

The dictionary comes from the column: fields that are one value by themselves, and values with marks inside that
stand in quotes or brackets somewhere, unless all that the marks part are known values as well (such a value may be a
list elsewhere).  Its ``MAX_KNOWN`` foremost values (those with marks first, then the most frequent) make the automaton
that is broadcast; the rest, if there is one, is joined to the stretches between marks, which gives the same hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import durable

MARKS = ",;/|&+\t\n\r"
MAX_KNOWN = 100_000  #: values of the automaton; the rest is joined
NULL_WORDS = ("", "NA")


def clean_value(piece: str) -> str:
    """Without outer blanks and outer quotes; doubled quotes inside are one."""
    s = piece.strip()
    for q in ('"', "'"):
        if len(s) >= 2 and s[0] == q and s[-1] == q and _closes(s, 0) == len(s) - 1:
            return s[1:-1].replace(q + q, q).strip()
    return s


def _closes(s: str, at: int) -> int:
    """Where the quote that opens at ``at`` closes; -1 if it doesn't.  Doubled quotes don't close."""
    q, i, n = s[at], at + 1, len(s)
    while (i := s.find(q, i)) >= 0:
        if i + 1 < n and s[i + 1] == q:
            i += 2
            continue
        if q == '"':
            return i
        tail = s[i + 1 : i + 2]  # an apostrophe inside a word closes nothing
        if not tail or not (tail.isalnum() or tail in "_"):
            return i
        i += 1
    return -1


def protected_marks(s: str, marks: str) -> list[tuple[int, bool]]:
    """(position, protected) of each mark; quotes open where a value starts, brackets anywhere."""
    out, i, n, start, depth = [], 0, len(s), True, 0
    last_close = s.rfind(")")
    while i < n:
        c = s[i]
        if start and c in "\"'" and (end := _closes(s, i)) > 0:
            out += [(k, True) for k in range(i, end) if s[k] in marks]
            i, start = end + 1, False
            continue
        if c == "(" and i < last_close:
            depth += 1
        elif c == ")" and depth:
            depth -= 1
            if depth == 0:
                last = s.rfind(")", i + 1)
                last_close = last if last > i else -1
        if c in marks:
            out.append((i, depth > 0))
            start = depth == 0
        elif not c.isspace():
            start = False
        i += 1
    if depth:  # a bracket that never closes protects nothing
        opened = _unclosed(s)
        out = [(k, p and not k > opened) for k, p in out]
    return out


def _unclosed(s: str) -> int:
    stack = []
    for i, c in enumerate(s):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            stack.pop()
    return stack[0] if stack else len(s)


class Segmenter:
    """The automaton over known values and the dynamic programme that picks a field's best cover."""

    def __init__(self, known: list[str], marks: str = MARKS, null_words: tuple[str, ...] = NULL_WORDS):
        self.marks, self.null_words = marks, null_words
        self.auto = ahocorasick.Automaton()
        for v in known:
            if v:
                self.auto.add_word(v, len(v))
        self.has = len(self.auto) > 0
        if self.has:
            self.auto.make_automaton()

    @staticmethod
    def unwrapped(field: str) -> str:
        s = field.strip()
        return s[1:-1] if len(s) >= 2 and s[0] == "[" and s[-1] == "]" else s

    def stretches(self, field: str, most: int) -> Iterator[tuple[int, int, str]]:
        """(i, j, text) of the stretches between two cuts with up to ``most`` marks inside."""
        s = self.unwrapped(field)
        cuts = [-1, *(p for p, _ in protected_marks(s, self.marks)), len(s)]
        for i in range(len(cuts) - 1):
            for j in range(i + 1, min(i + most + 2, len(cuts))):
                yield i, j, s[cuts[i] + 1 : cuts[j]].strip()

    def pieces(self, field: str, joined: Iterable[tuple[int, int, int]] = ()) -> list[str]:
        """The field's best cover; ``joined`` are hits (cut, cut, letters) found beside the automaton."""
        s = self.unwrapped(field)
        marks = protected_marks(s, self.marks)
        if not marks:
            return [s]
        cuts = [-1, *(p for p, _ in marks), len(s)]
        safe = [False, *(p for _, p in marks), False]  # protected cuts
        n = len(cuts) - 1
        hits: dict[int, list[tuple[int, int]]] = {}  # cut index -> (cut index, letters) of known values between two cuts
        for i, j, size in joined:
            hits.setdefault(i, []).append((j, size))
        if self.has:
            left = {self._skip(s, p + 1, 1): k for k, p in enumerate(cuts[:-1])}
            right = {self._skip(s, p - 1, -1): k for k, p in enumerate(cuts) if k}
            for end, size in self.auto.iter(s):
                i, j = left.get(end - size + 1), right.get(end)
                if i is not None and j is not None and i < j:
                    hits.setdefault(i, []).append((j, size))
        bare = [0]
        for k in range(1, n + 1):
            bare.append(bare[-1] + (0 < k < n and not safe[k]))
        worst = (1 << 60, 0, 0)
        best, back = [worst] * (n + 1), [0] * (n + 1)
        best[0] = (0, 0, 0)
        nxt = n
        ahead = [0] * (n + 1)  # next unprotected cut
        for k in range(n, -1, -1):
            ahead[k] = nxt
            if k < n and not safe[k]:
                nxt = k
        for i in range(n):
            v, c, m = best[i]
            for j, size in [(i + 1, 0), (ahead[i], 0), *hits.get(i, ())]:
                inner = bare[j - 1] - bare[i] if j > i + 1 and not size else 0
                cost = (v + inner + (j < n and safe[j]), c - size, m + 1)
                if cost < best[j]:
                    best[j], back[j] = cost, i
        out, j = [], n
        while j:
            i = back[j]
            out.append(s[cuts[i] + 1 : cuts[j]])
            j = i
        return out[::-1]

    @staticmethod
    def _skip(s: str, i: int, step: int) -> int:
        while 0 <= i < len(s) and s[i].isspace():
            i += step
        return i

    def values(self, field: str | None, joined: Iterable[tuple[int, int, int]] = ()) -> list[str]:
        """The cleaned values in order; empty pieces and null words take no place."""
        if field is None:
            return []
        return [v for v in map(clean_value, self.pieces(field, joined)) if v not in self.null_words]


def known_values(df: DataFrame, col: str, marks: str = MARKS) -> DataFrame:
    """(v, n, guard): the whole values that the column shows, how often, and whether they hold marks; over all rows."""
    field = df.select(F.col(col).alias("field")).where(F.col("field").isNotNull())
    plain = F.trim("field")
    class_ = "[" + re.escape(marks) + "]"
    open_ = F.col("field").rlike("[" + re.escape("\"'[]()") + "]")
    alone = field.select(plain.alias("v")).where(~plain.rlike("[" + re.escape(marks + "\"[]()") + "]") & ~plain.isin(*NULL_WORDS))
    alone = alone.groupBy("v").agg(F.count(F.lit(1)).alias("n"))

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = Segmenter([], marks)
        for pdf in batches:
            found = [v for f in pdf["field"] for v in seg.values(f) if any(c in marks for c in v)]
            yield pd.DataFrame({"v": pd.Series(found, dtype=object)})

    inside = field.where(open_ & F.col("field").rlike(class_)).mapInPandas(wrapped, "v string").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    part = F.explode(F.transform(F.split("v", class_), lambda x: F.trim(x))).alias("part")
    parts = inside.select("v", part).where("part <> ''")
    strange = parts.join(alone.select(F.col("v").alias("part")).hint("merge"), "part", "left_anti").select("v").distinct()
    guards = inside.join(strange.hint("merge"), "v", "left_semi")
    return alone.withColumn("guard", F.lit(False)).unionByName(guards.withColumn("guard", F.lit(True)))


@lru_cache(maxsize=4)
def _segmenter(known: tuple[str, ...], marks: str) -> Segmenter:
    return Segmenter(list(known), marks)


def _joined_hits(rows: DataFrame, rest: DataFrame, marks: str) -> DataFrame:
    """(row, hits): where values of ``rest`` stand between two marks, for the rows (row, field) that hold any."""
    inner = F.size(F.split("v", "[" + re.escape(marks) + "]")) - 1
    most = rest.agg(F.max(inner)).first()[0] or 0

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = Segmenter([], marks)
        for pdf in batches:
            got = [(r, i, j, x) for r, f in zip(pdf["row"], pdf["field"]) for i, j, x in seg.stretches(f, most) if x]
            yield pd.DataFrame(got, columns=["row", "i", "j", "v"])

    found = rows.mapInPandas(spans, "row bigint, i int, j int, v string").join(rest.select("v").hint("merge"), "v", "left_semi")
    return found.groupBy("row").agg(F.collect_list(F.struct("i", "j", F.length("v").alias("letters"))).alias("hits"))  # of one field


def split_packed(df: DataFrame, id_col: str, col: str, marks: str = MARKS, max_known: int = MAX_KNOWN) -> DataFrame:
    """(id, pos, value, n_values): one row per value of ``col``, ``pos`` from 1, repeated values kept.

    NULL and empty fields, and fields of null words only, give no row.  Rows that repeat an id are split each
    by itself.  Other columns are not read, so clashing names don't matter.  ``max_known`` changes no result.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.col(col).alias("field")).where(F.col("field").isNotNull())
    every = known_values(df, col, marks)
    foremost = every.orderBy(F.desc("guard"), F.desc("n"), "v").limit(max_known + 1).toArrow().column("v").to_pylist()
    known = spark.sparkContext.broadcast(tuple(foremost[:max_known]))
    src = src.withColumn("hits", F.lit(None).cast("array<struct<i:int,j:int,letters:int>>"))
    if len(foremost) > max_known:
        first = every.orderBy(F.desc("guard"), F.desc("n"), "v").limit(max_known).select("v")
        rest = durable(every.join(first.hint("merge"), "v", "left_anti"))
        rows = durable(src.drop("hits").withColumn("row", F.monotonically_increasing_id()))
        src = rows.join(_joined_hits(rows.select("row", "field"), rest, marks).hint("merge"), "row", "left").drop("row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = _segmenter(known.value, marks)
        for pdf in batches:
            more = [() if h is None else [(z["i"], z["j"], z["letters"]) for z in h] for h in pdf["hits"]]
            values = pd.Series([seg.values(f, h) for f, h in zip(pdf["field"], more)], index=pdf.index, dtype=object)
            yield pd.DataFrame({"id": pdf["id"], "vals": values})

    kind = dict(df.dtypes)[id_col]
    split = src.mapInPandas(run, f"id {kind}, vals array<string>")
    split = split.select("id", F.size("vals").alias("n_values"), F.posexplode("vals").alias("p", "value"))
    return split.select("id", (F.col("p") + 1).cast("int").alias("pos"), "value", "n_values")
