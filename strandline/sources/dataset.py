"""A study from a folder of tables in the public data set's form: cohorts, and two sources of species names."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.relational import cohort
from strandline.operators.study import LEVELS, UNDEFINED, Study
from strandline.sources import tables as S

POLICIES = ("silva", "rdp", "both", None)


def _names(col: str) -> Column:
    """The names of a species field: parted by '/', without blanks and empty ones."""
    parts = F.transform(F.split(F.coalesce(F.col(col), F.lit("")), "/"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def species_by_policy(policy: str | None, silva: str = "silva", rdp: str = "rdp", most: int = 2) -> Column:
    """The species label from one source, from both together, or undefined.

    Both: the sorted union of the names, without NA where others are; more than ``most`` names are undefined.  A source
    without names reads as undefined.
    """
    if policy not in POLICIES:
        raise ValueError(f"the species policy is one of {POLICIES}, not {policy!r}")
    if policy is None:
        return F.lit(UNDEFINED)
    names = F.array_union(_names(silva), _names(rdp)) if policy == "both" else F.array_distinct(_names(silva if policy == "silva" else rdp))
    known = F.array_sort(F.filter(names, lambda x: x != UNDEFINED))
    return F.when(F.size(known).between(1, most), F.array_join(known, "/")).otherwise(F.lit(UNDEFINED))


def with_species(taxa: DataFrame, other: DataFrame, policy: str | None, most: int = 2) -> DataFrame:
    """``taxa`` whose species come by ``policy`` from their own field (silva) and from ``other`` (name, species) (rdp)."""
    o = other.select(F.col("name").alias("_name"), F.col("species").alias("_rdp"))
    got = taxa.withColumnRenamed("species", "_silva").join(o, F.col("name") == F.col("_name"), "left")
    return got.withColumn("species", species_by_policy(policy, "_silva", "_rdp", most)).select(*taxa.columns)


def of_cohort(study: Study, subjects: list[str] | None, times: str | None = None) -> Study:
    """The samples whose name's first part is one of ``subjects``, and of their reads, qPCR and perturbations what belongs
    to them; None keeps all.  ``times`` keeps samples whose name contains it."""
    s = study.samples
    if subjects is not None:
        s = s.where(cohort("sample_id", subjects))
    if times is not None:
        s = s.where(F.col("sample_id").contains(times))
    who = s.select("subject").distinct()
    return study.replace(
        samples=s, reads=study.reads.join(s, "sample_id", "left_semi"), qpcr=study.qpcr.join(s, "sample_id", "left_semi"),
        perts=study.perts.join(who, "subject", "left_semi"),
    )


def load_dataset(
    spark: SparkSession, folder: str, cohorts: dict[str, list[str]] | None = None, name: str | None = None, species: str | None = "both",
    with_perturbations: bool = True, most_species: int = 2, sep: str = "\t",
) -> Study:
    """The study in ``folder``, cut to the cohort ``name``; None takes every sample.

    'replicates' and 'inoculum' are told by sample names; other cohorts are lists of subjects.  species_rdp.tsv
    (name, species), where it is there, is the second source of species.
    """
    study = S.read_study(spark, folder, sep)
    second = os.path.join(folder, "species_rdp.tsv")
    other = spark.read.csv(second, sep=sep, header=True) if os.path.exists(second) else spark.createDataFrame([], "name string, species string")
    study = study.replace(taxa=with_species(study.taxa, other, species, most_species).select("idx", "name", "sequence", *LEVELS))
    if not with_perturbations:
        study = study.replace(perts=study.perts.limit(0))
    marks = {"replicates": "M2-D", "inoculum": "inoculum"}  # fixed values
    if name in marks:
        return of_cohort(study, None, marks[name])
    if name is not None and name not in (cohorts or {}):
        raise ValueError(f"no cohort {name!r}")
    return study if name is None else of_cohort(study, (cohorts or {})[name])


def zero_inflation_mask(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(taxon, subject, time_from) of a mask table: a taxon counts as absent before its time; without a subject column
    in every subject (NULL)."""
    raw = spark.read.csv(path, sep=sep, header=True)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    subject = F.col("subject") if "subject" in raw.columns else F.lit(None).cast("string")
    time = [c for c in raw.columns if c not in ("taxon", "name", "subject")][0]
    taxon = "taxon" if "taxon" in raw.columns else "name"
    rows = raw.select(F.trim(taxon).alias("taxon"), subject.alias("subject"), F.col(time).try_cast("double").alias("time_from"))
    return rows.where("taxon is not null and time_from is not null")


def present_cells(study: Study, mask: DataFrame) -> DataFrame:
    """(sample_id, taxon_idx): samples at or after a taxon's time, as ``mask`` (taxon, subject, time_from) says; taxa
    that it doesn't name are always present.  Of several rows for one taxon and subject the latest counts."""
    m = mask.groupBy("taxon", "subject").agg(F.max("time_from").alias("time_from"))
    every = m.where("subject is null").select("taxon", F.col("time_from").alias("_all"))
    some = m.where("subject is not null").select("taxon", "subject", F.col("time_from").alias("_own"))
    cells = study.cells.join(every, "taxon", "left").join(some, ["taxon", "subject"], "left")
    late = lambda c: F.coalesce(F.col("time") >= F.col(c), F.lit(True))
    return cells.where(late("_all") & late("_own")).select("sample_id", "taxon_idx")
