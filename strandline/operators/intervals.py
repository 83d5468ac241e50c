"""Untidy intervals to continuous periods and gaps, by canonical dyadic blocks.

Intervals of integers [start, end) are cut into canonical dyadic blocks (level, index), two a level at most: an
interval of any length is at most 2 * TOP_LEVEL blocks.  Equal blocks of a key fold before the shuffle, so repeats and a
hot key cost no more than their distinct blocks.

Blocks below ``TILE_LEVEL`` meet in tiles of 2**TILE_LEVEL units, which hold fewer than 2**(TILE_LEVEL+1) of them.  Blocks
of that level and above are few and stand for themselves: those covered by an ancestor go, and so do the tiles that
one covers, by joins on (key, level, index) with the ancestors.  In a tile, blocks covered by an ancestor go, full
sibling pairs merge upward, and what is left is coalesced to stretches.  All stretches are disjoint then; those at the
borders of tiles are stitched: two a tile at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.keys import sample_key, trimmed
from strandline.operators.ordered import null_safe_join
from strandline.session import durable

TILE_LEVEL = 13  #: tiles of 8192 units
TOP_LEVEL = 62  #: bounds lie within -2**62 and 2**62, so a block of this level has index -1 or 0


def dyadic_blocks(start: np.ndarray, end: np.ndarray, top: int = TOP_LEVEL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, level, index) of the canonical blocks of each [start, end)."""
    row = np.arange(len(start))
    lo, hi = start.astype(np.int64).copy(), end.astype(np.int64).copy()
    out = []
    for level in range(top + 1):
        odd = (lo < hi) & (lo & 1 == 1)
        out.append((row[odd], np.full(odd.sum(), level), lo[odd]))
        lo = lo + odd
        odd = (lo < hi) & (hi & 1 == 1)
        hi = hi - odd
        out.append((row[odd], np.full(odd.sum(), level), hi[odd]))
        lo, hi = lo >> 1, hi >> 1
        going = lo < hi
        if not going.all():
            row, lo, hi = row[going], lo[going], hi[going]
    return tuple(np.concatenate(c) for c in zip(*out))


def merge_blocks(level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches that blocks cover: ancestors remove, siblings merge, neighbours coalesce."""
    start, end = index << level, (index + 1) << level
    order = np.lexsort((-level, start))  # a block stands right behind its ancestors
    level, index, end = level[order], index[order], end[order]
    before = np.append(np.iinfo(np.int64).min, np.maximum.accumulate(end)[:-1]) if len(end) else end
    free = end > before
    level, index = level[free], index[free]
    done, carried = [], np.empty(0, np.int64)  # pairs merged at the level below
    for lv in range(int(level.max(initial=-1)) + 1) if len(level) else ():
        own = np.union1d(index[level == lv], carried)
        left = own[:-1][(own[:-1] & 1 == 0) & (own[1:] == own[:-1] + 1)] if len(own) > 1 else own[:0]
        done.append((lv, own[~np.isin(own, np.concatenate([left, left + 1]))] if len(left) else own))
        carried = left >> 1
    lv = int(level.max(initial=-1)) + 1
    while len(carried):
        left = carried[:-1][(carried[:-1] & 1 == 0) & (carried[1:] == carried[:-1] + 1)]
        done.append((lv, carried[~np.isin(carried, np.concatenate([left, left + 1]))]))
        lv, carried = lv + 1, left >> 1
    start = np.concatenate([x << lv for lv, x in done] or [carried])
    end = np.concatenate([(x + 1) << lv for lv, x in done] or [carried])
    order = np.argsort(start)
    start, end = start[order], end[order]
    apart = start[1:] != end[:-1]
    return start[np.append(True, apart)[: len(start)]], end[np.append(apart, True)[: len(end)]]


def _decompose(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, level, index = dyadic_blocks(pdf["s"].to_numpy(), pdf["e"].to_numpy())
            out = pdf[keys].iloc[row].reset_index(drop=True)
            out["lv"], out["ix"] = level.astype(np.int32), index.astype(np.int64)
            yield out

    return run


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All tiles of a batch at once, each in a place of its own of twice a tile's width, so that none touch."""
    for pdf in batches:
        n = len(pdf)
        sizes = [len(b) for b in pdf["blocks"]]
        code = np.concatenate([np.asarray(b, np.int64) for b in pdf["blocks"]] or [np.empty(0, np.int64)])
        place = np.repeat(np.arange(n, dtype=np.int64), sizes) << (TILE_LEVEL + 1)
        level = code & 15
        s, e = merge_blocks(level, (place >> level) + (code >> 4))
        of = s >> (TILE_LEVEL + 1)
        shift = (pdf["tile"].to_numpy(np.int64)[of] << TILE_LEVEL) - (of << (TILE_LEVEL + 1))
        at = np.searchsorted(of, np.arange(1, n))
        out = pdf.drop(columns="blocks")
        out["starts"] = pd.Series(np.split(s + shift, at) if n else [], index=out.index, dtype=object)
        out["ends"] = pd.Series(np.split(e + shift, at) if n else [], index=out.index, dtype=object)
        yield out


def _uncovered(rows: DataFrame, large: DataFrame, keys: list[str], level: str, index: str, top: int) -> DataFrame:
    """``rows`` whose block (level, index) lies in none of the ``large`` blocks of a higher level."""
    up = F.explode(F.sequence(F.col(level) + 1, F.lit(top))).alias("_up")
    chain = rows.where(F.col(level) < top).select(*keys, level, index, up).select("*", F.expr(f"shiftright(`{index}`, _up - `{level}`)").alias("_at"))
    covers = large.select(*keys, F.col("lv").alias("_up"), F.col("ix").alias("_at"))
    hidden = null_safe_join(chain, covers, keys, ["_up", "_at"], "left_semi").select(*keys, level, index).distinct()
    return null_safe_join(rows, hidden, keys, [level, index], "left_anti")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(kind, keys, start, end): longest continuous stretches per key ('period') and what lies between two ('gap').

    ``start`` and ``end`` are bigint, half open, of any span within -2**62 and 2**62; a bound beyond raises an error.
    Rows with a NULL bound or with end <= start are left out; NULL keys are keys like others.  Touching, nested and
    repeated rows make one stretch.  Empty tables give no row; other columns are not read.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*keys, F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where(F.col("e") > F.col("s"))
    edge = F.lit(1 << TOP_LEVEL)
    wide = (F.col("s") < -edge) | (F.col("e") > edge)
    rows = rows.withColumn("s", F.when(wide, F.raise_error(F.lit("an interval reaches beyond 2**62")).cast("bigint")).otherwise(F.col("s")))
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    blocks = durable(rows.distinct().mapInPandas(_decompose(keys), f"{named}, lv int, ix bigint").distinct())
    small = blocks.where(F.col("lv") < TILE_LEVEL).withColumn("tile", F.expr(f"shiftright(ix, {TILE_LEVEL} - lv)"))
    code = (F.col("ix") - F.expr(f"shiftleft(tile, {TILE_LEVEL} - lv)")) * 16 + F.col("lv")  # its place in the tile, and its level
    tiles = small.groupBy(*keys, "tile").agg(F.collect_set(code).alias("blocks")).withColumn("level", F.lit(TILE_LEVEL - 1))
    large = blocks.where(F.col("lv") >= TILE_LEVEL)
    top = large.agg(F.max("lv")).first()[0]
    array = "starts array<bigint>, ends array<bigint>"
    if top is None:
        cut = tiles.drop("level").mapInPandas(_stretches, f"{named}, tile bigint, {array}")
    else:
        # a tile counts as half a level lower than TILE_LEVEL: the ancestors start at its own place
        tiles = tiles.withColumn("half", F.col("tile") * 2)
        free = _uncovered(tiles, large, keys, "level", "half", top).select(*keys, "tile", "blocks")
        alone = _uncovered(large, large, keys, "lv", "ix", top)
        whole = alone.select(*keys, F.expr(f"shiftleft(ix, lv - {TILE_LEVEL})").alias("tile"), F.expr("array(shiftleft(ix, lv))").alias("starts"), F.expr("array(shiftleft(ix + 1, lv))").alias("ends"))
        cut = free.mapInPandas(_stretches, f"{named}, tile bigint, {array}").unionByName(whole)
    cut = durable(cut)
    last = F.size("starts")
    inner = cut.select(*keys, F.posexplode(F.arrays_zip("starts", "ends")).alias("p", "z"), last.alias("m")).where("p > 0 and p < m - 1")
    inner = inner.select(*keys, F.col("z.starts").alias("s"), F.col("z.ends").alias("e"))
    local = cut.where("size(starts) > 1").select(*keys, F.posexplode("ends").alias("p", "s"), "starts").where("p < size(starts) - 1")
    local = local.select(*keys, "s", F.expr("starts[p + 1]").alias("e"))
    head = F.struct(F.col("starts")[0].alias("s"), F.col("ends")[0].alias("e"))
    tail = F.struct(F.element_at("starts", -1).alias("s"), F.element_at("ends", -1).alias("e"))
    ends = F.when(last > 1, F.array(head, tail)).otherwise(F.array(head))
    border = cut.select(*keys, "tile", F.explode(ends).alias("z")).select(*keys, "tile", "z.s", "z.e")
    line = Window.partitionBy(*keys).orderBy("s")
    border = border.withColumn("ps", F.lag("e").over(line)).withColumn("pt", F.lag("tile").over(line))
    new = F.coalesce((F.col("ps") != F.col("s")).cast("int"), F.lit(1))
    border = border.withColumn("isle", F.sum(new).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = border.groupBy(*keys, "isle").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("isle")
    across = border.where("pt <> tile and ps < s").select(*keys, F.col("ps").alias("s"), F.col("s").alias("e"))
    periods, gaps = inner.unionByName(joined), local.unionByName(across)
    every = periods.select(F.lit("period").alias("kind"), *keys, "s", "e").unionByName(gaps.select(F.lit("gap").alias("kind"), *keys, "s", "e"))
    return every.withColumnsRenamed({"s": "start", "e": "end"})


def study_intervals(perturbations: DataFrame) -> DataFrame:
    """(subject, name, start_hour, end_hour) of the rows with subject, name and two proper ends.

    Infinite ends, and days whose hour exceeds 2**62, are no hours and are left out.
    """
    rows = perturbations.where("start is not null and `end` is not null and not isnan(start) and not isnan(`end`) and `end` > start")
    rows = rows.where(f"abs(start) <= {float((1 << TOP_LEVEL) // 25)}D and abs(`end`) <= {float((1 << TOP_LEVEL) // 25)}D")
    hour = lambda c: F.round(F.col(c) * 24).cast("bigint")
    rows = rows.select(sample_key("subject").alias("subject"), F.lower(trimmed("name")).alias("name"), hour("start").alias("start_hour"), hour("end").alias("end_hour"))
    return rows.where("subject is not null and name is not null")
