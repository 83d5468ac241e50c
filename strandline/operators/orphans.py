"""References to records that do not exist: range-partitioned keys, sorted parents, binary search.

Parents are folded to one row per key, references to one row per table, key and month with their earliest and latest
load time; whether a reference was early or came after a withdrawal is decided by those two.  So a key with a third
of all references is a few rows before anything moves.  Both sides are range-partitioned together by key, into as many
ranges as PARTITION_ROWS asks for, and sorted, parents first; each partition keeps its parents as sorted arrays and probes the references batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import sample_key
from strandline.session import durable

NEVER = -(1 << 62)
PARTITION_ROWS = 200_000  #: folded rows that a range of keys should hold at most


def fold_parents(metadata: DataFrame, col: str, space: str) -> DataFrame:
    """(space, key, first_loaded, last_gone): last_gone is NULL unless all of the key's rows are withdrawn."""
    rows = metadata.select(sample_key(col).alias("key"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"), F.unix_micros(F.col("withdrawn_at").cast("timestamp")).alias("gone")).where("key is not null")
    folded = rows.groupBy("key").agg(F.min(F.coalesce("at", F.lit(NEVER))).alias("first_loaded"), F.max("gone").alias("g"), F.count(F.lit(1)).alias("n"), F.count("gone").alias("c"))
    return folded.select(F.lit(space).alias("space"), "key", "first_loaded", F.when(F.col("n") == F.col("c"), F.col("g")).alias("last_gone"))


def fold_references(df: DataFrame, table: str, col: str, space: str) -> DataFrame:
    """(space, key, ref_table, period, lo, hi, n): one row per key and month; period NULL without a load time."""
    rows = df.select(sample_key(col).alias("key"), F.date_format("loaded_at", "yyyy-MM").alias("period"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at")).where("key is not null")
    return rows.groupBy("key", "period").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n")).select(F.lit(space).alias("space"), "key", F.lit(table).alias("ref_table"), "period", "lo", "hi", "n")


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    keys = first = gone = None
    for pdf in batches:
        is_ref = pdf["is_ref"].to_numpy(bool)
        if not is_ref.all():
            held.append(pdf.loc[~is_ref, ["k", "first_loaded", "last_gone"]])
        refs = pdf[is_ref]
        if not len(refs):
            continue
        if keys is None:
            every = pd.concat(held) if held else pdf.loc[[], ["k", "first_loaded", "last_gone"]]
            keys = every["k"].to_numpy(object)
            first = every["first_loaded"].to_numpy(np.int64)
            gone = every["last_gone"].astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            held = []
        probe = refs["k"].to_numpy(object)
        lo = refs["lo"].astype("Int64").fillna(np.iinfo(np.int64).max - 1).to_numpy(np.int64)  # no load time: never early
        hi = refs["hi"].astype("Int64").fillna(np.iinfo(np.int64).min).to_numpy(np.int64)  # and never after a withdrawal
        if len(keys):
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            known = keys[at] == probe
            f, g = first[at], gone[at]
        else:
            known = np.zeros(len(refs), bool)
            f = g = np.zeros(len(refs), np.int64)
        late = known & (lo < f)
        withdrawn = known & (hi >= f) & (hi >= g)
        for kind, hit in (("missing", ~known), ("late", late), ("withdrawn", withdrawn)):
            if hit.any():
                out = refs.loc[hit, ["ref_table", "key", "period", "n"]].rename(columns={"key": "ref_key"})
                out["kind"] = kind
                yield out


def orphan_references(parents: DataFrame, references: DataFrame) -> DataFrame:
    """(ref_table, ref_key, period, n_rows, kind), a row per orphaned key, month and kind.

    ``n_rows`` counts the key's rows of the month.  A month may hold early rows and rows after a withdrawal; it gives
    both kinds then.  NULL keys are no references; empty parents make every reference 'missing'.
    """
    p = parents.select(F.concat_ws("\u0001", "space", "key").alias("k"), F.lit(0).alias("is_ref"), "first_loaded", "last_gone", *[F.lit(None).cast(t).alias(c) for c, t in (("ref_table", "string"), ("key", "string"), ("period", "string"), ("lo", "bigint"), ("hi", "bigint"), ("n", "bigint"))])
    r = references.select(F.concat_ws("\u0001", "space", "key").alias("k"), F.lit(1).alias("is_ref"), F.lit(None).cast("bigint").alias("first_loaded"), F.lit(None).cast("bigint").alias("last_gone"), "ref_table", "key", "period", "lo", "hi", "n")
    both = durable(p.unionByName(r))
    n = max(int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // PARTITION_ROWS))
    both = both.repartitionByRange(n, "k").sortWithinPartitions("is_ref", F.col("k").cast("binary"))
    return both.mapInPandas(_probe, "ref_table string, ref_key string, period string, n bigint, kind string").withColumnRenamed("n", "n_rows")


def study_orphans(metadata: DataFrame, qpcr: DataFrame, counts: DataFrame, perturbations: DataFrame) -> DataFrame:
    """Orphans among qpcr.sampleid, counts.sampleid and perturbations.subject against metadata."""
    parents = fold_parents(metadata, "sampleid", "sample").unionByName(fold_parents(metadata, "subject", "subject"))
    refs = fold_references(qpcr, "qpcr", "sampleid", "sample").unionByName(fold_references(counts, "counts", "sampleid", "sample")).unionByName(fold_references(perturbations, "perturbations", "subject", "subject"))
    return orphan_references(parents, refs)
