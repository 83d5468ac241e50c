"""The study model: typed long tables cleaned from deliveries, and the abundance hub.

Each function takes and returns DataFrames; nothing is collected.  Counts stay sparse: a taxon without a row in a
sample has count 0, and operators that need dense time use the sample's ordinal ``tidx`` within its subject.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.keys import latest, sample_key, trimmed
from strandline.session import read_table

# fixed values: taxonomic levels from the top, and the word for an undefined one
LEVELS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
UNDEFINED = "NA"


def level(name: str) -> Column:
    """A taxonomic level; NULL and empty ones read as undefined."""
    return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit(UNDEFINED)).alias(name)


def clean_taxa(taxonomy: DataFrame) -> DataFrame:
    """taxa(idx, name, sequence, seven levels), sequence without white space and gaps, in upper case."""
    return taxonomy.select("idx", "name", F.upper(F.regexp_replace("sequence", r"[\s\-]", "")).alias("sequence"), *[level(c) for c in LEVELS])


def clean_samples(metadata: DataFrame) -> DataFrame:
    """samples(sample_id, subject, time, tidx): latest delivery, never withdrawn, with subject and time.

    Of samples of one subject at one time the last by name stands.
    """
    rows = metadata.withColumn("sample_id", sample_key("sampleid")).withColumn("subj", sample_key("subject"))
    one = latest(rows.where("sample_id is not null"), ["sample_id"], "loaded_at", ["subj", "time", "withdrawn_at"])
    one = one.where("withdrawn_at is null and subj is not null and time is not null and not isnan(time)")
    one = one.groupBy(F.col("subj").alias("subject"), "time").agg(F.max("sample_id").alias("sample_id"))
    return one.select("sample_id", "subject", "time", (F.row_number().over(Window.partitionBy("subject").orderBy("time")) - 1).alias("tidx"))


def clean_reads(counts: DataFrame) -> DataFrame:
    """reads(sample_id, taxon, count): latest delivery of each cell; NULL counts are dropped, zeros stay."""
    rows = counts.withColumn("sample_id", sample_key("sampleid")).where("sample_id is not null and name is not null")
    return latest(rows, ["sample_id", "name"], "loaded_at", ["count"]).where("count is not null").select("sample_id", F.col("name").alias("taxon"), F.col("count").cast("bigint").alias("count"))


def clean_qpcr(qpcr: DataFrame) -> DataFrame:
    """qpcr(reading_id, sample_id, rep, density): each reading once, density above 0 and finite."""
    one = latest(qpcr, ["reading_id"], "loaded_at", ["sampleid", "rep", "cfu", "mass", "dilution"]).withColumn("sample_id", sample_key("sampleid"))
    ok = "sample_id is not null and cfu > 0 and cfu < double('Infinity') and mass > 0"
    return one.where(ok).select("reading_id", "sample_id", "rep", (F.col("cfu") * F.col("dilution") / F.col("mass")).alias("density"))


def clean_perturbations(perturbations: DataFrame) -> DataFrame:
    """perts(name, pidx, subject, start, end): distinct proper intervals with key forms; active when start < t <= end."""
    rows = perturbations.where("start is not null and `end` is not null and not isnan(start) and not isnan(`end`) and `end` > start")
    rows = rows.select(F.lower(trimmed("name")).alias("name"), "pidx", sample_key("subject").alias("subject"), "start", "end")
    return rows.where("subject is not null").distinct()


def biomass(qpcr: DataFrame) -> DataFrame:
    """(sample_id, n, loc, scale, gmean, mean_lognormal, var_lognormal) of the replicate densities of each sample."""
    stats = qpcr.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.ln("density")).alias("loc"), F.stddev_pop(F.ln("density")).alias("scale"))
    s2 = F.col("scale") * F.col("scale")
    return stats.select("*", F.exp("loc").alias("gmean"), F.exp(F.col("loc") + s2 / 2).alias("mean_lognormal"), ((F.exp(s2) - 1) * F.exp(2 * F.col("loc") + s2)).alias("var_lognormal"))


@dataclass(frozen=True)
class Study:
    """The five tables of a study; derived tables are built on demand."""

    taxa: DataFrame
    samples: DataFrame
    reads: DataFrame
    qpcr: DataFrame
    perts: DataFrame
    scale: float = 1.0

    @classmethod
    def load(cls, spark: SparkSession, d: str) -> Study:
        t = {n: read_table(spark, d, n) for n in ("taxonomy", "metadata", "counts", "qpcr", "perturbations")}
        return cls(clean_taxa(t["taxonomy"]), clean_samples(t["metadata"]), clean_reads(t["counts"]), clean_qpcr(t["qpcr"]), clean_perturbations(t["perturbations"]))

    def replace(self, **tables: DataFrame) -> Study:
        return replace(self, **tables)

    @cached_property
    def cells(self) -> DataFrame:
        """(sample_id, subject, time, tidx, taxon_idx, taxon, raw): reads of known samples and taxa."""
        named = self.taxa.select(F.col("name").alias("taxon"), F.col("idx").alias("taxon_idx"))
        return self.reads.join(self.samples, "sample_id").join(named, "taxon").select("sample_id", "subject", "time", "tidx", "taxon_idx", "taxon", F.col("count").alias("raw"))

    @cached_property
    def depth(self) -> DataFrame:
        """(sample_id, depth)."""
        return self.cells.groupBy("sample_id").agg(F.sum("raw").alias("depth"))

    @cached_property
    def biomass(self) -> DataFrame:
        return biomass(self.qpcr)

    @cached_property
    def abundance(self) -> DataFrame:
        """The hub: cells with depth, rel, biomass and abs; rel NULL at depth 0, abs NULL without biomass."""
        total = F.sum("raw").over(Window.partitionBy("sample_id"))
        rel = F.try_divide(F.col("raw"), F.col("depth"))
        g = self.biomass.select("sample_id", (F.col("gmean") * F.lit(self.scale)).alias("biomass"))
        return self.cells.withColumn("depth", total).withColumn("rel", rel).join(g, "sample_id", "left").withColumn("abs", F.col("rel") * F.col("biomass"))

    def pop_taxa(self, gone: DataFrame) -> Study:
        """Without the taxa named in ``gone`` (name); the rest are numbered anew from 0, in order."""
        kept = self.taxa.join(gone.select("name"), "name", "left_anti")
        return self.replace(taxa=renumber(kept))

    def keep_taxa(self, kept: DataFrame) -> Study:
        return self.replace(taxa=renumber(self.taxa.join(kept.select("name").distinct(), "name", "left_semi")))

    def split_subjects(self, picked: Column) -> tuple[Study, Study]:
        """(picked subjects, the others), every table cut the same way; taxa are shared."""

        def half(cond: Column) -> Study:
            s = self.samples.where(cond)
            return self.replace(samples=s, perts=self.perts.where(cond), reads=self.reads.join(s, "sample_id", "left_semi"), qpcr=self.qpcr.join(s, "sample_id", "left_semi"))

        return half(picked), half(~picked)

    def pop_times(self, times: DataFrame) -> Study:
        """Without the samples at ``times`` (subject, time); times that don't exist are passed over."""
        kept = self.samples.join(times, ["subject", "time"], "left_anti")
        return self.replace(samples=kept.withColumn("tidx", F.row_number().over(Window.partitionBy("subject").orderBy("time")) - 1))

    def normalise_qpcr(self, top: float) -> DataFrame:
        """(factor): what makes the largest geometric mean ``top``."""
        return self.biomass.join(self.samples, "sample_id", "left_semi").agg((F.lit(top) / F.max("gmean")).alias("factor"))


def renumber(taxa: DataFrame, idx: str = "idx") -> DataFrame:
    """Dense indexes from 0 in the old order, without a single-task window: ranks within index buckets plus the
    buckets' running totals, of which there are few."""
    width = 8192
    b = taxa.withColumn("_b", F.floor(F.col(idx) / width))
    sums = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(idx, "name")) - 1
    return b.withColumn("_r", rank).join(before, "_b").withColumn(idx, (F.col("_before") + F.col("_r")).cast("int")).drop("_b", "_r", "_before")
