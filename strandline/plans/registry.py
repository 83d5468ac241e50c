"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import core_dealt, kernel_queries, model_queries, posterior_queries, report_queries, study_queries

MODULES = [core_dealt, study_queries, posterior_queries, kernel_queries, report_queries, model_queries]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE
    return out


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return study_queries.QUERIES["flagship"](spark, d)
