"""Ordered work per key without one task per key: histograms cut hot keys into blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096  #: histogram cells of a hot key


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], plain: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where NULL meets NULL, and on ``plain``; the right side's copies are renamed away."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys + plain})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    for k in plain:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right, on, how)


def has_hot(df: DataFrame, keys: list[str], limit: int) -> bool:
    """Whether a key has more than ``limit`` rows: one aggregate, folded before the shuffle; a single row comes back."""
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).isEmpty()


def with_blocks(df: DataFrame, keys: list[str], order: str, target_rows: int) -> DataFrame:
    """``df`` with a column ``blk`` that rises with ``order`` within each key.

    Keys of ``target_rows`` rows or fewer are one block.  Larger ones get an equal-width histogram of CELLS cells
    over their own range; cells are packed into blocks of about ``target_rows`` rows.  Only a single cell can
    exceed that, where very many rows share nearly the same place.  NULL keys form groups like any other value.
    ``df`` is counted once to see whether there are such keys at all, so it should be cheap to read.
    """
    if not has_hot(df, keys, target_rows):
        return df.withColumn("blk", F.lit(0))
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")).where(F.col("_n") > target_rows)
    # hot keys number at most rows/target_rows
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(CELLS - 1), F.floor((F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS).cast("int"))).otherwise(F.lit(0))
    tagged = null_safe_join(df, stats, keys, [], "left").select(*df.columns, F.when(F.col("_n").isNull(), F.lit(-1)).otherwise(cell).alias("_cell"))
    hot = tagged.where("_cell >= 0").groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    blocks = hot.select(*keys, "_cell", F.floor(F.coalesce(before, F.lit(0)) / target_rows).cast("int").alias("_b"))
    return null_safe_join(tagged, blocks, keys, ["_cell"], "left").select(*df.columns, F.coalesce("_b", F.lit(0)).alias("blk"))


def group_median(df: DataFrame, keys: list[str], value: str, name: str, limit: int = 50_000) -> DataFrame:
    """(keys, name): the exact median of ``value`` per key, mean of the middle two.  NULL values are left out.

    Keys of up to ``limit`` rows go through the built-in aggregate, whose state is one key's values; larger ones through
    ``_hot_median``.  The result doesn't depend on the limit.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    plain = F.median("_v").alias(name)
    if not has_hot(rows, keys, limit):
        return rows.groupBy(*keys).agg(plain)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")
    small = null_safe_join(rows, sizes, keys, [], "left_anti").groupBy(*keys).agg(plain)
    return small.unionByName(_hot_median(null_safe_join(rows, sizes, keys, [], "left_semi"), keys, "_v", name))


def _hot_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The median without gathering a key.

    Three rounds of counting narrow the middle ranks: 64 cells a unit, 4096 cells within each, then the distinct
    values of the one cell left, all pre-aggregated before the shuffle.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    rows = counts.withColumn("_c1", F.floor(F.col("_v") * 64)).withColumn("_c2", F.floor(F.col("_v") * 64 * 4096))

    def narrow(cells: DataFrame, by: str, ranks: DataFrame | None) -> DataFrame:
        """(keys, which, rank within the cell, cell) of the cells that hold the middle ranks."""
        part = [*keys] if ranks is None else [*keys, "_w"]
        w = Window.partitionBy(*part).orderBy(by)
        cum = cells.withColumn("_hi", F.sum("_m").over(w)).withColumn("_lo", F.col("_hi") - F.col("_m"))
        if ranks is None:
            total = F.sum("_m").over(Window.partitionBy(*part))
            cum = cum.withColumn("_n", total).withColumn("_ranks", F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
            cum = cum.select("*", F.posexplode("_ranks").alias("_w", "_r"))
        return cum.where((F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi"))).select(*keys, "_w", (F.col("_r") - F.col("_lo")).alias("_r"), by)

    def joined(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
        return null_safe_join(left, right, keys, [by], "inner").select(*left.columns, "_w", "_r")

    one = narrow(rows.groupBy(*keys, "_c1").agg(F.sum("_c").alias("_m")), "_c1", None)
    sub = joined(rows, one, "_c1")
    two = narrow(sub.groupBy(*keys, "_w", "_r", "_c2").agg(F.sum("_c").alias("_m")), "_c2", one)
    last = joined(rows, two, "_c2").withColumnRenamed("_c", "_m")
    got = narrow(last.select(*keys, "_w", "_r", "_v", "_m"), "_v", two)
    return got.groupBy(*keys).agg((F.sum("_v") / F.count("_v")).alias(name))
