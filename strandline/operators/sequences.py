"""Ordered-sequence operators over (subject, taxon) series: run filters, deltas, smoothing, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.relational import outside_perturbations
from strandline.operators.study import Study


def consistent_taxa(study: Study, dtype: str, threshold: float, consecutive: int, subjects: int, colonization: float = 0.0) -> DataFrame:
    """(taxon): at least ``threshold`` in ``consecutive`` successive samples of at least ``subjects`` subjects.

    A taxon without a row in a sample breaks its run: cells are numbered by the sample's ordinal, so only rows that
    reach the threshold travel.
    """
    rows = study.abundance.where((F.col("time") >= colonization) & (F.col(dtype) >= threshold)).select("subject", "taxon", "tidx")
    w = Window.partitionBy("subject", "taxon").orderBy("tidx")
    run = rows.withColumn("full", F.col("tidx") - F.lag("tidx", consecutive - 1).over(w) == consecutive - 1) if consecutive > 1 else rows.withColumn("full", F.lit(True))
    return run.where("full").groupBy("taxon").agg(F.count_distinct("subject").alias("n")).where(F.col("n") >= subjects).select("taxon")


def conditional_consistent_taxa(study: Study, other: Study, dtype: str, threshold: float, upper: int, lower: int, subjects: int, colonization: float = 0.0) -> DataFrame:
    """(taxon): passes ``lower`` here, and ``upper`` here or in the other study."""
    low = consistent_taxa(study, dtype, threshold, lower, subjects, colonization)
    high = consistent_taxa(study, dtype, threshold, upper, subjects, colonization).union(consistent_taxa(other, dtype, threshold, upper, subjects, colonization))
    return low.intersect(high)


def segments_outside(samples: DataFrame, perts: DataFrame) -> DataFrame:
    """(subject, time, segment): samples outside perturbations, numbered by unbroken stretch from 0."""
    kept = outside_perturbations(samples, perts).select("subject", "time", "tidx")
    w = Window.partitionBy("subject").orderBy("tidx")
    new = F.coalesce((F.col("tidx") - F.lag("tidx").over(w) > 1).cast("int"), F.lit(0))
    return kept.withColumn("new", new).withColumn("k", F.sum("new").over(w)).select("subject", "time", F.concat_ws("_", "subject", F.col("k").cast("string")).alias("segment"))


def deltas(samples: DataFrame) -> DataFrame:
    """(subject, time, dt): time to the next sample; the last has none."""
    w = Window.partitionBy("subject").orderBy("time")
    return samples.withColumn("dt", F.lead("time").over(w) - F.col("time")).where("dt is not null").select("subject", "time", "tidx", "dt")


def log_growth(study: Study, dtype: str = "abs") -> DataFrame:
    """(subject, time, tidx, taxon_idx, y): (ln x' - ln x) / dt between successive samples that both hold the taxon."""
    rows = study.abundance.where(F.col(dtype) > 0).select("subject", "time", "tidx", "taxon_idx", F.col(dtype).alias("x"))
    w = Window.partitionBy("subject", "taxon_idx").orderBy("tidx")
    nxt = F.lead(F.struct("tidx", "time", "x")).over(w)
    return rows.withColumn("nxt", nxt).where("nxt.tidx = tidx + 1").select("subject", "time", "tidx", "taxon_idx", ((F.ln("nxt.x") - F.ln("x")) / (F.col("nxt.time") - F.col("time"))).alias("y"))


def rolling_acceptance(trace: DataFrame, part: list[str], order: str, value: str, prev: int) -> DataFrame:
    """Acceptance rate over up to ``prev`` earlier draws, the current one not among them."""
    w = Window.partitionBy(*part).orderBy(order)
    ch = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    rows = trace.withColumn("i", F.row_number().over(w) - 1).withColumn("ch", ch)
    near = F.sum("ch").over(w.rowsBetween(-(prev - 1), -1))
    return rows.withColumn("rate", F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.coalesce(near, F.lit(0)) / F.least("i", F.lit(prev)))).drop("ch")


def moving_average(rows: DataFrame, part: list[str], time: str, value: str, bandwidth: float) -> DataFrame:
    """Mean of the values with time in [t - b, t + b), by a range frame less the rows exactly at t + b."""
    over = f"over (partition by {', '.join(f'`{c}`' for c in part)} order by `{time}` range between {{0}} and {bandwidth}D following)"
    near, at = over.format(f"{bandwidth}D preceding"), over.format(f"{bandwidth}D following")
    s = F.expr(f"sum(`{value}`) {near} - coalesce(sum(`{value}`) {at}, 0)")
    n = F.expr(f"count(`{value}`) {near} - count(`{value}`) {at}")
    return rows.withColumn("smooth", F.try_divide(s, n))


def interpolate(rows: DataFrame, part: list[str], time: str, value: str) -> DataFrame:
    """NULL values on the line between their neighbours in time; beyond the ends the nearest value."""
    back = Window.partitionBy(*part).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*part).orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    r = rows.withColumn("_k", known).withColumn("_a", F.last("_k", True).over(back)).withColumn("_b", F.first("_k", True).over(on))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(F.col(time) - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    return r.withColumn("filled", F.coalesce(F.col(value), line, F.col("_a.v"), F.col("_b.v"))).drop("_k", "_a", "_b")


def densify(samples: DataFrame, times: DataFrame) -> DataFrame:
    """(subject, time, given): every subject at every time of ``times``, beyond its own span too.

    Times travel as one array for each day of the grid and are opened last, so the grid itself is never shuffled.
    """
    day = F.floor("time").alias("day")
    days = times.select("time").distinct().groupBy(day).agg(F.collect_list("time").alias("at"))
    own = samples.groupBy("subject", day).agg(F.collect_set("time").alias("own"))
    cells = samples.select("subject").distinct().crossJoin(days.select("day"))
    marked = cells.join(own, ["subject", "day"], "left").join(days, "day").select("subject", "own", F.explode("at").alias("time"))
    return marked.select("subject", "time", F.coalesce(F.array_contains("own", F.col("time")), F.lit(False)).alias("given"))


def step_points(samples: DataFrame, step: float, eps: float) -> DataFrame:
    """(subject, time, given): given times plus a grid of ``step`` over each subject's span, without grid points that
    lie within ``eps`` of a given time."""
    span = samples.groupBy("subject").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    n = F.floor((F.col("hi") - F.col("lo")) / step).cast("int")
    grid = span.select("subject", F.explode(F.sequence(F.lit(0), n)).alias("k"), "lo").select("subject", F.round(F.col("lo") + F.col("k") * step, 6).alias("time"))
    # the given times are looked up by cells of eps: three equal-key probes instead of a range join
    cell = F.floor(F.col("time") / eps)
    near = samples.select("subject", F.col("time").alias("g"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    extra = grid.withColumn("cell", cell).join(near, ["subject", "cell"], "left").groupBy("subject", "time").agg(F.min(F.abs(F.col("g") - F.col("time"))).alias("d")).where(F.col("d").isNull() | (F.col("d") > eps))
    return samples.select("subject", "time", F.lit(True).alias("given")).unionByName(extra.select("subject", "time", F.lit(False).alias("given")))


def density_points(samples: DataFrame, n: int) -> DataFrame:
    """(subject, time, given): ``n`` evenly spaced points inside every gap."""
    w = Window.partitionBy("subject").orderBy("time")
    nxt = samples.select("subject", "time", F.lead("time").over(w).alias("nxt"))
    at = nxt.select("subject", "time", "nxt", F.explode(F.sequence(F.lit(0), F.when(F.col("nxt").isNull(), 0).otherwise(n))).alias("k"))
    return at.select("subject", F.when(F.col("k") == 0, F.col("time")).otherwise(F.col("time") + (F.col("nxt") - F.col("time")) * F.col("k") / (n + 1)).alias("time"), (F.col("k") == 0).alias("given"))


def equal_buckets(rows: DataFrame, value: str, ties: str, buckets: int, part: list[str]) -> DataFrame:
    """Buckets of n div L rows by rank within ``part``; the last takes the remainder (not ntile)."""
    w = Window.partitionBy(*part)
    rank = F.row_number().over(w.orderBy(value, ties)) - 1
    size = F.greatest(F.floor(F.count(F.lit(1)).over(w) / buckets), F.lit(1))
    return rows.withColumn("bucket", F.least(F.floor(rank / size), F.lit(buckets - 1)).cast("int"))


def fractional_index(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """(subject, mark, position): a time as a fractional sample index, linear between the neighbours; NULL outside."""
    w = Window.partitionBy("subject").orderBy("time")
    s = samples.select("subject", "time", "tidx", F.lead("time").over(w).alias("nxt"))
    j = marks.join(s, "subject").where("mark >= time and (mark < nxt or (nxt is null and mark = time))")
    return j.select("subject", "mark", (F.col("tidx") + F.coalesce(F.try_divide(F.col("mark") - F.col("time"), F.col("nxt") - F.col("time")), F.lit(0.0))).alias("position"))


def even_subsample(samples: DataFrame, n: int) -> DataFrame:
    """(subject, time): at most ``n`` samples of each subject, evenly strided, first included."""
    total = F.count(F.lit(1)).over(Window.partitionBy("subject"))
    k = F.floor(F.col("tidx") * n / total)
    before = F.floor((F.col("tidx") - 1) * n / total)
    return samples.withColumn("keep", (F.col("tidx") == 0) | (k > before)).where("keep").select("subject", "time")
