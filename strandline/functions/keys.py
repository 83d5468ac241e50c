"""Key forms of names, and the latest delivery of repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTER_BLANKS = r"(?U)^\s+|\s+$"


def trimmed(col: str) -> F.Column:
    """The text without outer white space of any kind."""
    return F.regexp_replace(F.col(col), OUTER_BLANKS, "")


def sample_key(col: str) -> F.Column:
    """Key form: without outer white space, in upper case.  NULL and blank names have none."""
    key = F.upper(trimmed(col))
    return F.when(key != "", key)


def latest(df: DataFrame, keys: list[str], stamp: str, columns: list[str]) -> DataFrame:
    """One row per ``keys``: that of the latest ``stamp``; ties go to the largest values, rows without stamp come first.

    A map-side aggregate, so a key delivered very often is folded before the shuffle.
    """
    best = F.max(F.struct(F.col(stamp), *[F.col(c) for c in columns])).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
