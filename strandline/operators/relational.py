"""Filters, joins, aggregates, set operations and top-k over the study model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.study import LEVELS, UNDEFINED, Study

AGGREGATES = {"mean": F.avg, "median": F.median, "sum": F.sum, "max": F.max, "min": F.min}


def active(time: str = "time", start: str = "start", end: str = "end") -> Column:
    """The study's end-point rule: active when start < t <= end."""
    return (F.col(time) > F.col(start)) & (F.col(time) <= F.col(end))


def active_on_grid(time: str = "time", start: str = "start", end: str = "end") -> Column:
    """The simulation's rule: on for grid times in [start, end)."""
    return (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))


def active_by_index(tidx: str = "tidx", start: str = "start_idx", end: str = "end_idx") -> Column:
    """The design matrices' rule: rows in the index slice [start, end)."""
    return (F.col(tidx) >= F.col(start)) & (F.col(tidx) < F.col(end))


def cohort(sample_id: str, prefixes: list[str]) -> Column:
    """The part before the first '-' is one of ``prefixes``."""
    return F.split_part(F.col(sample_id), F.lit("-"), F.lit(1)).isin(*prefixes)


def interval_join(samples: DataFrame, perts: DataFrame) -> DataFrame:
    """Each sample with the perturbations active on it; samples outside any keep one row of NULLs."""
    p = perts.withColumnRenamed("subject", "p_subject").withColumnRenamed("name", "pert")
    return samples.join(p, (F.col("subject") == F.col("p_subject")) & active(), "left").drop("p_subject")


def outside_perturbations(samples: DataFrame, perts: DataFrame) -> DataFrame:
    p = perts.withColumnRenamed("subject", "p_subject")
    return samples.join(p, (F.col("subject") == F.col("p_subject")) & active(), "left_anti")


def nearest_index(samples: DataFrame, perts: DataFrame) -> DataFrame:
    """(name, subject, start, end, start_idx, end_idx): the first sample at or after the start and the last at or
    before the end; an interval that holds no sample has NULLs, one sample gives [s, s + 1)."""
    s = samples.select("subject", "time", "tidx")
    p = perts.select("name", "subject", "start", "end")
    j = p.join(s, "subject", "left").groupBy("name", "subject", "start", "end").agg(F.min(F.when(F.col("time") >= F.col("start"), F.col("tidx"))).alias("a"), F.max(F.when(F.col("time") <= F.col("end"), F.col("tidx"))).alias("z"))
    ok = F.col("a") <= F.col("z")
    return j.select("name", "subject", "start", "end", F.when(ok, F.col("a")).alias("start_idx"), F.when(ok, F.when(F.col("a") == F.col("z"), F.col("z") + 1).otherwise(F.col("z"))).alias("end_idx"))


def unknown_references(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks; ingest refuses a study that has some."""
    return left.join(right, key, "left_anti").select(key).distinct()


def aggregate_over_subjects(study: Study, dtype: str, agg: str, times: str = "union") -> DataFrame:
    """(taxon_idx, time, value): raw, rel or abs over the subjects that have a sample at each time.

    ``times`` is 'union' or 'intersection'.  Absent cells of a present sample count as 0.
    """
    at = study.samples.groupBy("time").agg(F.count(F.lit(1)).alias("present"))
    if times == "intersection":
        at = common_times(study.samples).join(at, "time")
    cells = study.abundance.join(at, "time")
    value = F.col(dtype).cast("double")
    zeros = F.col("present") - F.count(F.lit(1))
    if agg == "median":  # a median must see the zeros: the cells are few per taxon and time, one per subject
        padded = F.concat(F.collect_list(value), F.array_repeat(F.lit(0.0), (F.first("present") - F.count(F.lit(1))).cast("int")))
        got = cells.groupBy("taxon_idx", "time").agg(F.array_sort(padded).alias("v"))
        n = F.size("v")
        mid = (F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.floor(n / 2).cast("int") + 1)) / 2
        return got.select("taxon_idx", "time", mid.alias("value"))
    got = cells.groupBy("taxon_idx", "time", "present").agg(F.sum(value).alias("s"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.count(F.lit(1)).alias("n"))
    short = F.col("n") < F.col("present")
    pick = {"sum": F.col("s"), "mean": F.col("s") / F.col("present"), "max": F.when(short, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")), "min": F.when(short, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))}
    return got.select("taxon_idx", "time", pick[agg].alias("value"))


def lineage(to: str | None) -> list[str]:
    """Columns of the lineage down to a level; None and 'asv' add the taxon itself."""
    return list(LEVELS) if to in (None, "asv") else list(LEVELS[: LEVELS.index(to) + 1])


def smart_label(to: str) -> Column:
    """The level's name; where it is undefined the lowest defined level above names it: 'Order ABC, Family NA'."""
    above = list(reversed(LEVELS[: LEVELS.index(to)]))
    tail = F.lit(f", {to.capitalize()} {UNDEFINED}")
    named = F.coalesce(*[F.when(F.col(u) != UNDEFINED, F.concat(F.lit(f"{u.capitalize()} "), F.col(u), tail)) for u in above], F.lit(UNDEFINED)) if above else F.lit(UNDEFINED)
    return F.when(F.col(to) != UNDEFINED, F.col(to)).otherwise(named)


def cluster_by_level(study: Study, dtype: str, to: str) -> DataFrame:
    """(subject, time, lineage columns, label, value, members): sums by full lineage."""
    keys = lineage(to)
    cells = study.abundance.join(study.taxa.select(F.col("idx").alias("taxon_idx"), *keys), "taxon_idx")
    got = cells.groupBy("subject", "time", *keys).agg(F.sum(dtype).alias("value"), F.count_distinct("taxon_idx").alias("members"))
    return got.withColumn("label", smart_label(to))


def aggregate_items(study: Study, bridge: DataFrame) -> DataFrame:
    """(subject, time, otu, raw): reads of an OTU's components summed; ``bridge`` is (otu, taxon)."""
    return study.cells.join(bridge, "taxon").groupBy("subject", "time", "otu").agg(F.sum("raw").alias("raw"))


def common_times(samples: DataFrame) -> DataFrame:
    """(time): times that every subject has (relational division)."""
    n = samples.agg(F.count_distinct("subject").alias("n"))
    return samples.groupBy("time").agg(F.count_distinct("subject").alias("k")).join(n, F.col("k") == F.col("n")).select("time")


def top_taxa(study: Study, dtype: str, n: int, bottom: bool = False) -> DataFrame:
    """(taxon, total): the n taxa of the largest (or smallest) total; ties by name."""
    total = study.abundance.groupBy("taxon").agg(F.sum(dtype).alias("total")).where("total is not null")
    return total.orderBy(F.asc("total") if bottom else F.desc("total"), "taxon").limit(n)


def top_with_other(study: Study, n: int) -> DataFrame:
    """(subject, time, label, rel): the top n taxa and, per sample, what is left as 'Other'."""
    top = top_taxa(study, "rel", n).select("taxon")
    rows = study.abundance.where("rel is not null")
    some = rows.join(F.broadcast(top), "taxon").select("subject", "time", F.col("taxon").alias("label"), "rel")  # n rows
    left = some.groupBy("subject", "time").agg(F.sum("rel").alias("got"))
    other = rows.select("subject", "time").distinct().join(left, ["subject", "time"], "left").select("subject", "time", F.lit("Other").alias("label"), (1 - F.coalesce("got", F.lit(0.0))).alias("rel"))
    return some.unionByName(other)


def average_rank(value: str, part: list[str]) -> Column:
    """Rank with ties averaged, from 1."""
    w = Window.partitionBy(*part)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*part, value)) - 1) / 2
