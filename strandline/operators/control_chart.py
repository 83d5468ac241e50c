"""Implausible spikes: robust exponentially weighted control charts, run-length counters, physical limits.

Every source has a baseline, the exact median of its values and the median distance from it.  The chart
follows the readings in time with an exponentially weighted mean and scale; a value beyond the limit is
clipped before it updates either.  Mean and scale are held within ``MEAN_BAND`` and ``SCALE_BAND`` of the
baseline, and ``MEAN_BAND + LIMIT * SCALE_BAND`` doesn't exceed ``reach``; so whatever lies further than
``reach`` baseline scales from the baseline is a suspect of the chart.  An exact check on the suspects decides.

Sources of up to ``block_rows`` readings move once: all sources of a batch are judged together as arrays, baseline, chart
and runs in one pass.  A hot source, with more, is never gathered: its baseline comes from counts, it is charted in
blocks of about ``block_rows`` readings (``ordered.with_blocks``), each from the source's baseline, and runs that cross
blocks are stitched from the blocks' border runs.  The exact check makes both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.keys import latest, sample_key
from strandline.operators.ordered import group_median, has_hot, null_safe_join, with_blocks
from strandline.session import durable

MEAN_WEIGHT, SCALE_WEIGHT = 0.15, 0.05  #: weights of a new reading
CLIP = 2.0  #: scales to which a reading is clipped before it updates the chart
MEAN_BAND, SCALE_BAND = 3.0, 2.0  #: baseline scales the mean may stray; times the baseline scale the scale may grow
BLOCK_ROWS = 50_000


def judged_readings(qpcr: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, source, series, time, tie, raw, mass, dilution): each reading once, by its latest delivery.

    Left out are readings of NULL cfu, without a known sample, of withdrawn samples, and of samples without subject.
    A time that is NULL or NaN becomes NULL.
    """
    q = latest(qpcr.where("reading_id is not null"), ["reading_id"], "loaded_at", ["sampleid", "rep", "cfu", "mass", "dilution"])
    q = q.where("cfu is not null").withColumn("sample", sample_key("sampleid")).where("sample is not null")
    m = metadata.select(sample_key("sampleid").alias("sample"), sample_key("subject").alias("subject"), F.expr("nullif(time, double('NaN'))").alias("time"), "loaded_at", "withdrawn_at")
    last = F.max(F.struct("loaded_at", "subject", "time")).alias("last")  # rows without load time come first
    m = m.where("sample is not null").groupBy("sample").agg(last, F.max("withdrawn_at").alias("gone")).where("gone is null and last.subject is not null")
    m = m.select("sample", F.col("last.subject").alias("source"), F.col("last.time").alias("time"))
    return q.join(m, "sample").select(F.col("reading_id").alias("id"), "source", F.col("rep").alias("series"), "time", F.col("sample").alias("tie"), F.col("cfu").alias("raw"), "mass", "dilution")


def _chart(limit: float, reach: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, mean, scale = None, 0.0, 0.0
        for pdf in batches:
            out = np.zeros(len(pdf), bool)
            where = np.empty(len(pdf))
            cols = (pdf[c].tolist() for c in ("source", "blk", "x", "mid", "spread"))
            for i, (source, blk, x, mid, spread) in enumerate(zip(*cols)):
                if (source, blk) != key:
                    key, mean, scale = (source, blk), mid, spread
                d = x - mean
                where[i] = mean
                out[i] = abs(d) > limit * scale
                edge = CLIP * scale
                d = min(max(d, -edge), edge)
                mean = min(max(mean + MEAN_WEIGHT * d, mid - MEAN_BAND * spread), mid + MEAN_BAND * spread)
                scale = min(max(scale + SCALE_WEIGHT * (abs(d) - scale), 0.5 * spread), SCALE_BAND * spread)
            hit = pdf[out]
            yield pd.DataFrame({"id": hit["id"], "source": hit["source"], "x": hit["x"], "mid": hit["mid"], "spread": hit["spread"], "chart_mean": where[out]})

    return run


def chart_suspects(rows: DataFrame, reach: float = 10.0, least: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, source, x, mid, spread, chart_mean) of the values beyond the control limits.

    ``rows`` has (id, source, time, x); x is finite or NULL (not charted).  Sources of fewer than ``least`` values
    have no chart.  A superset of the values further than ``reach`` spreads from the source's median.
    """
    rows = rows.where("x is not null")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = durable(rows.join(sizes.select("source"), "source"))
    mid = durable(group_median(rows, ["source"], "x", "mid", block_rows))
    dist = rows.join(mid, "source").withColumn("dist", F.abs(F.col("x") - F.col("mid")))
    base = mid.join(group_median(dist, ["source"], "dist", "spread", block_rows), "source")
    limit = (reach - MEAN_BAND) / SCALE_BAND * (1 - 1e-9)
    placed = with_blocks(rows.select("id", "source", F.coalesce("time", F.lit(0.0)).alias("t"), "x"), ["source"], "t", block_rows)
    placed = placed.join(base, "source").repartition("source", "blk").sortWithinPartitions("source", "blk", "t", "id")
    kind = dict(rows.dtypes)["id"]
    return placed.mapInPandas(_chart(limit, reach), f"id {kind}, source string, x double, mid double, spread double, chart_mean double")


def stuck_values(rows: DataFrame, least_run: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, run_length): readings in runs of ``least_run`` or more equal usable values of one source and series.

    ``rows`` has (id, source, series, time, tie, raw); rows without time don't count as neighbours.  A raw value
    that is not finite and above 0 equals nothing.
    """
    ok = F.col("raw").between(5e-324, 1.7976931348623157e308)
    rows = rows.where("time is not null").select("id", "source", "series", "time", "tie", F.when(ok, F.col("raw")).alias("v"))
    rows = with_blocks(rows, ["source", "series"], "time", block_rows)
    part = ["source", "series", "blk"]
    w = Window.partitionBy(*part).orderBy("time", "tie", "id")
    new = F.coalesce(F.lag("v").over(w) != F.col("v"), F.lit(True)).cast("int")
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*part, "run").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))
    blocks = Window.partitionBy(*part)
    runs = runs.withColumn("top", F.max("run").over(blocks))
    inner = runs.where((F.col("run") > 1) & (F.col("run") < F.col("top"))).select(*part, "run", F.col("n").alias("total"))
    border = runs.where((F.col("run") == 1) | (F.col("run") == F.col("top")))  # two a block at most
    line = Window.partitionBy("source", "series").orderBy("blk", "run")
    apart = F.coalesce((F.lag("blk").over(line) == F.col("blk")) | (F.lag("v").over(line) != F.col("v")), F.lit(True)).cast("int")
    border = border.withColumn("apart", apart).withColumn("isle", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    border = border.select(*part, "run", F.sum("n").over(Window.partitionBy("source", "series", "isle")).alias("total"))
    long = inner.unionByName(border).where(F.col("total") >= least_run)
    return null_safe_join(rows.where("v is not null"), long, ["source", "series"], ["blk", "run"]).select("id", F.col("total").alias("run_length"))


def group_middle(code: np.ndarray, value: np.ndarray, n_groups: int) -> np.ndarray:
    """The exact median of each group, mean of the middle two; NaN for an empty one."""
    order = np.lexsort((value, code))
    n = np.bincount(code, minlength=n_groups)
    start = np.cumsum(n) - n
    v = np.append(value[order], np.nan)
    some = n > 0
    low, high = np.where(some, start + (n - 1) // 2, len(v) - 1), np.where(some, start + n // 2, len(v) - 1)
    return (v[low] + v[high]) / 2


def chart_steps(x: np.ndarray, start: np.ndarray, n: np.ndarray, mid: np.ndarray, spread: np.ndarray, limit: float, few: int = 16) -> np.ndarray:
    """Which values of the charts, each a stretch of ``x`` from ``start`` of ``n`` values in time, leave the limits.

    The charts advance together, a reading each; when ``few`` are left they go on one by one.
    """
    out = np.zeros(len(x), bool)
    order = np.argsort(-n, kind="stable")
    start, n, mid, spread = start[order], n[order], mid[order], spread[order]
    mean, scale = mid.copy(), spread.copy()
    k, t = len(n), 0
    while True:
        k = int(np.searchsorted(-n[:k], -t, side="left"))  # charts longer than t
        if k <= few:
            break
        at = start[:k] + t
        d = x[at] - mean[:k]
        out[at] = np.abs(d) > limit * scale[:k]
        edge = CLIP * scale[:k]
        d = np.clip(d, -edge, edge)
        mean[:k] = np.clip(mean[:k] + MEAN_WEIGHT * d, mid[:k] - MEAN_BAND * spread[:k], mid[:k] + MEAN_BAND * spread[:k])
        scale[:k] = np.clip(scale[:k] + SCALE_WEIGHT * (np.abs(d) - scale[:k]), 0.5 * spread[:k], SCALE_BAND * spread[:k])
        t += 1
    for j in range(k):
        m, s, c, w = float(mean[j]), float(scale[j]), float(mid[j]), float(spread[j])
        for i, v in enumerate(x[start[j] + t : start[j] + n[j]].tolist(), int(start[j]) + t):
            d = v - m
            out[i] = abs(d) > limit * s
            edge = CLIP * s
            d = min(max(d, -edge), edge)
            m = min(max(m + MEAN_WEIGHT * d, c - MEAN_BAND * w), c + MEAN_BAND * w)
            s = min(max(s + SCALE_WEIGHT * (abs(d) - s), 0.5 * w), SCALE_BAND * w)
    return out


def _judge(pdf: pd.DataFrame, reach: float, least: int, least_run: int) -> pd.DataFrame:
    """The implausible readings of whole sources."""
    code = np.cumsum(pdf["source"].ne(pdf["source"].shift()).to_numpy()) - 1
    groups = int(code[-1]) + 1 if len(code) else 0
    x, time = pdf["x"].to_numpy(float), pdf["time"].to_numpy(float)
    ids = pd.factorize(pdf["id"], sort=True)[0]
    spike = np.zeros(len(pdf), bool)
    n = np.bincount(code[~np.isnan(x)], minlength=groups)
    rows = np.flatnonzero(~np.isnan(x) & (n[code] >= least))
    if len(rows):
        rows = rows[np.lexsort((ids[rows], np.nan_to_num(time[rows], nan=0.0), code[rows]))]
        c, v = code[rows], x[rows]
        mid = group_middle(c, v, groups)
        far = np.abs(v - mid[c])
        spread = group_middle(c, far, groups)
        there = np.unique(c)
        n = np.bincount(c, minlength=groups)[there]
        limit = (reach - MEAN_BAND) / SCALE_BAND * (1 - 1e-9)
        suspect = chart_steps(v, np.cumsum(n) - n, n, mid[there], spread[there], limit)
        spike[rows] = suspect & (far > reach * spread[c])  # the exact check
    run = np.zeros(len(pdf), np.int64)
    rows = np.flatnonzero(~np.isnan(time))
    if len(rows):
        series, tie = pd.factorize(pdf["series"], sort=True)[0], pd.factorize(pdf["tie"], sort=True)[0]
        rows = rows[np.lexsort((ids[rows], tie[rows], time[rows], series[rows], code[rows]))]
        raw = pdf["raw"].to_numpy(float)[rows]
        v = np.where(np.isfinite(raw) & (raw > 0), raw, np.nan)
        new = np.ones(len(rows), bool)
        new[1:] = (v[1:] != v[:-1]) | (code[rows[1:]] != code[rows[:-1]]) | (series[rows[1:]] != series[rows[:-1]])
        length = np.diff(np.append(np.flatnonzero(new), len(rows)))[np.cumsum(new) - 1]
        run[rows] = np.where(~np.isnan(v) & (length >= least_run), length, 0)
    bad = pdf["bad"].to_numpy(bool)
    hit = bad | spike | (run > 0)
    return pd.DataFrame({"id": pdf["id"][hit], "impossible": bad[hit], "spike": spike[hit], "stuck": run[hit] > 0, "run_length": run[hit].astype(np.int32)})


def _whole_sources(reach: float, least: int, least_run: int):
    """mapInPandas body over rows sorted by source; a source's rows wait until they are all there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["source"].to_numpy() != pdf["source"].iloc[-1]
            done = int(last.sum())  # rows of sources that end in this batch stand first
            if held and (done or held[-1]["source"].iloc[-1] != pdf["source"].iloc[-1]):
                yield _judge(pd.concat([*held, pdf.iloc[:done]], ignore_index=True), reach, least, least_run)
                held = []
            elif done:
                yield _judge(pdf.iloc[:done].reset_index(drop=True), reach, least, least_run)
            held.append(pdf.iloc[done:])
        if held:
            yield _judge(pd.concat(held, ignore_index=True), reach, least, least_run)

    return run


def implausible_readings(qpcr: DataFrame, metadata: DataFrame, reach: float = 10.0, least: int = 10, least_run: int = 5, top_density: float = 1e14, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, impossible, spike, stuck, run_length): one row per implausible reading.

    Impossible: cfu negative, NaN or infinite, mass not above 0, or a density above ``top_density``.  A NULL or NaN
    mass makes no density.  Empty tables give no row; columns beside those named are not read.
    """
    rows = judged_readings(qpcr, metadata)
    finite = F.col("raw").between(-1.7976931348623157e308, 1.7976931348623157e308)
    density = F.when(F.col("mass") > 0, F.col("raw") * F.col("dilution") / F.col("mass"))
    x = F.when(finite & (F.col("raw") > 0) & (F.col("mass") > 0) & (density > 0) & ~F.isnan(density), F.log10(density))
    x = F.when(x.between(-1e308, 1e308), x)
    bad = ~finite | (F.col("raw") < 0) | (F.col("mass") <= 0) | ((density > top_density) & ~F.isnan(density))
    rows = durable(rows.select("id", "source", "series", "time", "tie", "raw", x.alias("x"), F.coalesce(bad, F.lit(False)).alias("bad")))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, impossible boolean, spike boolean, stuck boolean, run_length int"
    cold, hot = rows, None
    if has_hot(rows, ["source"], block_rows):
        large = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("source")
        cold, hot = rows.join(large, "source", "left_anti"), durable(rows.join(large, "source", "left_semi"))
    found = cold.repartition("source").sortWithinPartitions("source").mapInPandas(_whole_sources(reach, least, least_run), schema)
    return found if hot is None else found.unionByName(_hot_sources(hot, reach, least, least_run, block_rows))


def _hot_sources(rows: DataFrame, reach: float, least: int, least_run: int, block_rows: int) -> DataFrame:
    """The same for sources that no task may hold as a whole."""
    suspects = chart_suspects(rows, reach, least, block_rows)
    spikes = suspects.where(F.abs(F.col("x") - F.col("mid")) > reach * F.col("spread"))  # the exact check
    stuck = stuck_values(rows, least_run, block_rows)
    no, yes = F.lit(0), F.lit(1)
    found = rows.where("bad").select("id", yes.alias("a"), no.alias("b"), no.alias("r"))
    found = found.unionByName(spikes.select("id", no.alias("a"), yes.alias("b"), no.alias("r")))
    found = found.unionByName(stuck.select("id", no.alias("a"), no.alias("b"), F.col("run_length").cast("int").alias("r")))
    marks = [(F.max(c) > 0).alias(n) for c, n in (("a", "impossible"), ("b", "spike"), ("r", "stuck"))]
    return found.groupBy("id").agg(*marks, F.max("r").alias("run_length"))
