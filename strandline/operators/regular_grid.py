"""Irregular readings onto a regular grid: an as-of merge of grid and readings per source.

Readings are first folded per source and grid cell, so the rows of a cell never travel.  Sources are cut into
blocks of ``BLOCK_CELLS`` cells; a block holds no more cells than that, whatever the source's length, and gets
its neighbours' nearest readings as carried rows.  Within a block, grid and readings are merged in order and each
empty cell takes the last reading before and the first one after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.keys import sample_key

BLOCK_CELLS = 1024
MOST_CELLS = 100_000_000  #: cells between a source's first and last reading, at most; more raise an error


def study_samples(metadata: DataFrame) -> DataFrame:
    """(source, t, tie) of samples never withdrawn that have a subject and a time; deliveries are not merged."""
    rows = metadata.where("withdrawn_at is null and time is not null and not isnan(time)")
    rows = rows.select(sample_key("subject").alias("source"), F.col("time").alias("t"), sample_key("sampleid").alias("tie"))
    return rows.where("source is not null")


def regular_grid(readings: DataFrame, step: float = 1.0, gap_limit: float | None = None, block_cells: int = BLOCK_CELLS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(source, cell, grid_time, n_readings, value, t_before, t_after, state): one row per source and grid cell.

    ``readings`` has (source, t, value); cells run from a source's first to its last, cell = floor(t / step).
    state is 'observed' (value: the mean of the cell's readings), 'filled' (time-weighted line between the readings
    on both sides, at the cell's start) or 'gap' (they are more than ``gap_limit`` apart, or one lacks a value; value NULL).
    Rows without source, or whose t is NULL, NaN or infinite, are left out.  Repeated and tied readings count as given
    in the mean; of tied nearest readings the mean of their values stands on the line.  A source of more than
    ``most_cells`` cells from first to last, as one wrong time can make it, raises an error that names it.
    """
    r = readings.where("source is not null and t is not null and not isnan(t) and abs(t) < double('Infinity')")
    r = r.select("source", F.floor(F.col("t") / F.lit(float(step))).alias("cell"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
    # first by instant (ties), then by cell
    inst = r.groupBy("source", "cell", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.count("value").alias("c"))
    mean = F.expr("try_divide(s, c)")
    cells = inst.groupBy("source", "cell").agg(
        F.sum("n").alias("n"), F.expr("try_divide(sum(s), sum(c))").alias("value"), F.min(F.struct("t", mean.alias("v"))).alias("head"), F.max(F.struct("t", mean.alias("v"))).alias("tail")
    )
    cells = cells.withColumn("blk", F.floor(F.col("cell") / F.lit(block_cells)))
    # borders: what the nearest blocks with readings hold at their ends; one row a block
    ends = cells.groupBy("source", "blk").agg(F.min("cell").alias("c0"), F.max("cell").alias("c1"), F.min_by("head", "cell").alias("first"), F.max_by("tail", "cell").alias("last"))
    line = Window.partitionBy("source").orderBy("blk")
    first = F.first("c0").over(line)
    far = F.raise_error(F.concat(F.lit("more cells than most_cells allows in source "), F.col("source").cast("string")))
    ends = ends.withColumn("blk", F.when(F.col("c1").cast("double") - first < F.lit(most_cells), F.col("blk")).otherwise(far.cast("bigint")))
    ends = ends.withColumn("carried", F.lag("last").over(line)).withColumn("ahead", F.lead("first").over(line)).withColumn("nblk", F.lead("blk").over(line)).withColumn("nc0", F.lead("c0").over(line))
    # the grid: each block's own span, reaching to the next one's first cell; long empty stretches are cut at block edges
    edge = F.lit(block_cells)
    stop = F.coalesce(F.col("nc0") - 1, F.col("c1"))
    pieces = ends.select("source", "c0", "c1", "carried", "last", "ahead", stop.alias("stop"), "blk", F.explode(F.sequence(F.col("blk"), F.greatest("blk", F.floor(stop / edge)))).alias("gblk"))
    own = F.col("gblk") == F.col("blk")
    grid = pieces.select(
        "source", F.explode(F.sequence(F.greatest("c0", F.col("gblk") * edge), F.least("stop", (F.col("gblk") + 1) * edge - 1))).alias("cell"), F.col("blk").alias("part"),
        "gblk", F.when(own, F.col("carried")).otherwise(F.col("last")).alias("carried"), "ahead",
    )
    got = grid.join(cells.select("source", "cell", "n", "value", "head", "tail").hint("merge"), ["source", "cell"], "left")
    up = Window.partitionBy("source", "part", "gblk").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("source", "part", "gblk").orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    before = F.coalesce(F.last("tail", True).over(up), "carried")
    after = F.coalesce(F.first("head", True).over(down), "ahead")
    out = got.withColumn("b", before).withColumn("a", after).withColumn("grid_time", F.col("cell") * F.lit(float(step)))
    apart = F.col("a.t") - F.col("b.t")
    fits = F.lit(True) if gap_limit is None else apart <= F.lit(float(gap_limit))
    share = F.expr("try_divide(grid_time - b.t, a.t - b.t)")
    fill = F.when(fits, F.col("b.v") + (F.col("a.v") - F.col("b.v")) * share)
    seen = F.col("n").isNotNull()
    state = F.when(seen, "observed").when(fill.isNotNull(), "filled").otherwise("gap")
    return out.select(
        "source", F.col("cell").cast("bigint").alias("cell"), "grid_time", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_readings"), F.when(seen, F.col("value")).otherwise(fill).alias("value"),
        F.col("b.t").alias("t_before"), F.col("a.t").alias("t_after"), state.alias("state"),
    )
