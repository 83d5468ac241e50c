"""Sources and sinks: study TSV tables, initial conditions, trace tables, whole studies as Parquet."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.distributions import generator
from strandline.operators.study import LEVELS, Study, level, renumber

METADATA = "sampleID string, subject string, time double"
PERTURBATIONS = "name string, start double, end double, subject string"
INITIAL = "taxon string, abundance double"
TABLES = ("taxa", "samples", "reads", "qpcr", "perts")


class BadStudy(ValueError):
    """A table refers to a sample or taxon that the study lacks."""


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t") -> DataFrame:
    """A TSV by header; with a schema columns are matched by name, extra columns are not read."""
    if schema is None:
        return spark.read.csv(path, sep=sep, header=True)
    want = [f.strip().split()[0] for f in schema.split(",")]
    raw = spark.read.csv(path, sep=sep, header=True)
    missing = [c for c in want if c not in raw.columns]
    if missing:
        raise BadStudy(f"{path}: no column {', '.join(missing)}")
    kinds = dict(f.strip().split() for f in schema.split(","))
    return raw.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in want])


def read_samples(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    rows = read_tsv(spark, path, METADATA, sep).select(F.col("sampleID").alias("sample_id"), "subject", "time")
    return rows.withColumn("tidx", F.row_number().over(Window.partitionBy("subject").orderBy("time")) - 1)


def read_counts(spark: SparkSession, path: str, samples: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """The wide table unpivoted; ``samples`` are picked before the unpivot, so other columns are never parsed."""
    wide = spark.read.csv(path, sep=sep, header=True)
    name, cols = wide.columns[0], wide.columns[1:]
    cols = [c for c in cols if samples is None or c in set(samples)]
    long = wide.select(F.col(f"`{name}`").alias("taxon"), *[F.col(f"`{c}`").try_cast("double").cast("bigint").alias(c) for c in cols])
    return long.unpivot("taxon", cols, "sample_id", "count").where("count is not null")


def read_qpcr(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Replicates unpivoted; missing ones drop out."""
    wide = spark.read.csv(path, sep=sep, header=True)
    name, cols = wide.columns[0], wide.columns[1:]
    long = wide.select(F.col(f"`{name}`").alias("sample_id"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols]).unpivot("sample_id", cols, "m", "density")
    rep = F.regexp_extract("m", r"(\d+)$", 1).cast("int")
    return long.where("density is not null and not isnan(density)").select(F.xxhash64("sample_id", "m").alias("reading_id"), "sample_id", rep.alias("rep"), "density")


def read_taxonomy(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Taxa in file order; header case doesn't matter, missing levels are undefined, name and sequence are mandatory."""
    raw = spark.read.csv(path, sep=sep, header=True)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    for c in ("name", "sequence"):
        if c not in raw.columns:
            raise BadStudy(f"{path}: no column {c}")
    for c in LEVELS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    ordered = raw.withColumn("_at", F.monotonically_increasing_id())
    return renumber(ordered.select(F.col("_at").alias("idx"), "name", "sequence", *[level(c) for c in LEVELS]))


def read_perturbations(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    rows = read_tsv(spark, path, PERTURBATIONS, sep).withColumn("_at", F.monotonically_increasing_id())
    first = rows.groupBy("name").agg(F.min("_at").alias("_first"))
    order = first.select("name", (F.row_number().over(Window.orderBy("_first")) - 1).alias("pidx"))  # one row per perturbation
    return rows.join(order, "name").select("name", "pidx", "subject", "start", "end")


def read_study(spark: SparkSession, folder: str, sep: str = "\t") -> Study:
    """A study from metadata.tsv, taxonomy.tsv, counts.tsv, qpcr.tsv and perturbations.tsv; the last three are optional.

    Raises BadStudy where counts or qPCR name a sample that metadata lacks.
    """
    p = {n: os.path.join(folder, f"{n}.tsv") for n in ("metadata", "taxonomy", "counts", "qpcr", "perturbations")}
    samples, taxa = read_samples(spark, p["metadata"], sep), read_taxonomy(spark, p["taxonomy"], sep)
    empty = spark.createDataFrame
    reads = read_counts(spark, p["counts"], None, sep) if os.path.exists(p["counts"]) else empty([], "taxon string, sample_id string, count bigint")
    qpcr = read_qpcr(spark, p["qpcr"], sep) if os.path.exists(p["qpcr"]) else empty([], "reading_id bigint, sample_id string, rep int, density double")
    perts = read_perturbations(spark, p["perturbations"], sep) if os.path.exists(p["perturbations"]) else empty([], "name string, pidx int, subject string, start double, end double")
    for what, t in (("counts", reads), ("qpcr", qpcr)):
        lost = t.join(samples, "sample_id", "left_anti").select("sample_id").distinct().take(3)
        if lost:
            raise BadStudy(f"{what} names unknown samples, such as {[r[0] for r in lost]}")
    return Study(taxa, samples, reads.select("sample_id", "taxon", "count"), qpcr, perts)


def write_tsv(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    """A folder with TSV parts."""
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def wide_counts(study: Study) -> DataFrame:
    """A row per taxon, a column per sample: as wide as the study is long, so for export of small studies only."""
    names = [r[0] for r in study.samples.select("sample_id").orderBy("sample_id").collect()]
    if len(names) > 10_000:
        raise BadStudy("too many samples for a wide table")
    return study.cells.groupBy(F.col("taxon").alias("name")).pivot("sample_id", names).agg(F.sum("raw")).na.fill(0)


def write_wide_counts(study: Study, path: str, sep: str = "\t") -> None:
    """The wide counts as TSV parts with a header each: a row per taxon, a column per sample, of any number of samples.

    A taxon's row is one array, so there is no plan of as many columns; the samples' names are the header and come to
    the driver.
    """
    names = [r[0] for r in study.samples.select("sample_id").orderBy("sample_id").collect()]
    place = study.samples.select("sample_id", (F.row_number().over(Window.orderBy("sample_id")) - 1).alias("at"))
    rows = study.cells.join(place, "sample_id").groupBy("taxon").agg(F.map_from_entries(F.collect_list(F.struct("at", "raw"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(max(len(names), 1) - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("string"))
    lines = rows.select(F.concat_ws(sep, "taxon", F.array_join(full, sep)).alias("value"))
    header = sep.join(["name", *names])

    def headed(batches):  # type: ignore[no-untyped-def]
        import pandas as pd

        first = True
        for pdf in batches:
            if len(pdf):
                yield pd.concat([pd.DataFrame({"value": [header]}), pdf]) if first else pdf
                first = False

    lines.mapInPandas(headed, "value string").write.mode("overwrite").text(path)


def wide_qpcr(study: Study) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("sample_id").orderBy("rep", "reading_id"))
    rows = study.qpcr.withColumn("k", k)
    most = rows.agg(F.max("k")).first()[0] or 0
    return rows.groupBy(F.col("sample_id").alias("sampleID")).agg(*[F.max(F.when(F.col("k") == i, F.col("density"))).alias(f"measurement{i}") for i in range(1, most + 1)])


def write_study_tsv(study: Study, folder: str, sep: str = "\t") -> None:
    """The five tables of a study, each a folder of TSV parts."""
    write_tsv(study.samples.select(F.col("sample_id").alias("sampleID"), "subject", "time"), f"{folder}/metadata.tsv", sep)
    write_tsv(study.taxa.orderBy("idx").select("name", "sequence", *LEVELS).coalesce(1), f"{folder}/taxonomy.tsv", sep)
    write_wide_counts(study, f"{folder}/counts.tsv", sep)
    write_tsv(wide_qpcr(study), f"{folder}/qpcr.tsv", sep)
    write_tsv(study.perts.select("name", "start", "end", "subject"), f"{folder}/perturbations.tsv", sep)


def save_study(study: Study, folder: str) -> None:
    """Parquet tables and a note of the scale."""
    for n in TABLES:
        getattr(study, n).write.mode("overwrite").parquet(f"{folder}/{n}")
    spark = study.taxa.sparkSession
    spark.createDataFrame([(json.dumps({"scale": study.scale}),)], "note string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load_study(spark: SparkSession, folder: str) -> Study:
    note = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    return Study(*[spark.read.parquet(f"{folder}/{n}") for n in TABLES], scale=note["scale"])


def read_initial_conditions(spark: SparkSession, path: str, taxa: DataFrame, sep: str = "\t") -> DataFrame:
    """(idx, abundance) from a headerless two-column table; raises where a taxon has none."""
    raw = spark.read.csv(path, sep=sep, header=False)
    if len(raw.columns) != 2:
        raise BadStudy(f"{path} has {len(raw.columns)} columns; two are expected")
    x = raw.toDF("name", "abundance").select("name", F.col("abundance").try_cast("double").alias("abundance"))
    lost = taxa.join(x, "name", "left_anti").select("name").take(3)
    if lost:
        raise BadStudy(f"no initial abundance for {[r[0] for r in lost]}")
    return taxa.join(x, "name").select("idx", "abundance")


def read_clustering(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(cid, item) of a cluster assignment table: 'cluster', then its members, in lines or in columns.

    Lines hold a cluster's name and one member each; a line of one field names the cluster of the lines under it, the
    form that reports have.  NULL and blank fields are passed over.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("at", "line"))  # one small file
    cells = lines.select("at", F.split("line", sep).alias("c")).select("at", F.trim(F.col("c")[0]).alias("a"), F.trim(F.try_element_at("c", F.lit(2))).alias("b"))
    cells = cells.where("coalesce(a, '') <> '' or coalesce(b, '') <> ''")
    alone = F.coalesce(F.col("b"), F.lit("")) == ""
    named = F.last(F.when(alone, F.col("a")), True).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    cid = F.when(F.col("a") != "", F.col("a")).otherwise(F.lit(None))
    rows = cells.withColumn("under", named).where(~alone)
    return rows.select(F.coalesce(cid, "under").alias("cid"), F.col("b").alias("item"))


def clustering_of(table: DataFrame, taxa: list[str]) -> tuple[int, ...]:
    """The cluster number of each taxon, numbered in the order of first members; raises where one is missing or has two."""
    got: dict[str, set[str]] = {}
    for r in table.collect():  # a row per taxon of a model
        got.setdefault(r["item"], set()).add(r["cid"])
    lost = [t for t in taxa if len(got.get(t, ())) != 1]
    if lost:
        raise BadStudy(f"the clustering gives no single cluster for {lost[:3]}")
    order: dict[str, int] = {}
    return tuple(order.setdefault(next(iter(got[t])), len(order)) for t in taxa)


def make_toy(study: Study, n_taxa: int = 15) -> Study:
    """The study with its first taxa only."""
    return study.replace(taxa=study.taxa.where(F.col("idx") < n_taxa))


def random_taxa(spark: SparkSession, n: int, seed: int = 0, letters: int = 50) -> DataFrame:
    """taxa of random sequences; each depends on seed and index only, so any partitioning gives the same."""
    import pandas as pd

    def run(batches):  # type: ignore[no-untyped-def]
        for pdf in batches:
            seqs = ["".join(generator(seed, "taxon", int(i)).choice(list("ATGC"), letters)) for i in pdf["id"]]
            yield pd.DataFrame({"idx": pdf["id"].astype("int32"), "name": [f"TAXA_{i + 1}" for i in pdf["id"]], "sequence": seqs})

    return spark.range(n).mapInPandas(run, "idx int, name string, sequence string")


# ---------------------------------------------------------------- traces


def append_trace(df: DataFrame, folder: str) -> None:
    """Appends draws; rows carry chain and var, which partition the table."""
    df.write.mode("append").partitionBy("chain", "var").parquet(folder)


def overwrite_trace(df: DataFrame, folder: str) -> None:
    """Replaces the (chain, var) partitions that ``df`` holds and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chain", "var").parquet(folder)


def read_trace(spark: SparkSession, folder: str, var: str | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows if var is None else rows.where(F.col("var") == var)
