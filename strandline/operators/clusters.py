"""Operations on cluster assignments: moving members, matching name spaces, ordering, ranges and colours."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.relational import aggregate_items
from strandline.operators.study import Study


def move_items(members: DataFrame, moves: DataFrame) -> DataFrame:
    """``members`` (item, cid) after ``moves`` (item, to): each item goes to the cluster named, which may be new.

    A NULL target takes the item out of every cluster.  Items not in ``members`` join their target; of several moves of
    one item the largest target counts.  Clusters that lose their last item are gone.
    """
    m = moves.groupBy("item").agg(F.max("to").alias("to"), F.lit(True).alias("moved"))
    both = members.join(m, "item", "full")
    return both.where("moved is null or to is not null").select("item", F.when(F.col("moved"), F.col("to")).otherwise(F.col("cid")).alias("cid"))


def own_cluster(members: DataFrame, items: DataFrame) -> DataFrame:
    """``members`` after each of ``items`` (item) got a cluster of its own, numbered behind the largest number in use."""
    top = members.agg(F.coalesce(F.max("cid"), F.lit(-1)).alias("top"))
    order = Window.partitionBy(F.lit(0)).orderBy("item")  # the items of one model
    new = items.distinct().join(F.broadcast(top)).select("item", (F.col("top") + F.row_number().over(order)).alias("to"))
    return move_items(members, new)


def merge_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``members`` with each cluster of ``pairs`` (cid, into) merged into another."""
    p = pairs.groupBy("cid").agg(F.max("into").alias("into"))
    return members.join(p, "cid", "left").select("item", F.coalesce("into", "cid").alias("cid"))


def mismatched_names(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """(name, side): names that only one of two clusterings has; a clustering can be taken over only if there are none."""
    a, b = left.select(name).distinct(), right.select(name).distinct()
    only = lambda x, y, side: x.join(y, name, "left_anti").select(name, F.lit(side).alias("side"))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def take_clustering(taxa: DataFrame, clustering: DataFrame) -> DataFrame:
    """(idx, name, cid): the clusters of another study's clustering (name, cid) by taxon name."""
    return taxa.select("idx", "name").join(clustering.select("name", "cid"), "name")


def order_by_keystoneness(ky: DataFrame) -> DataFrame:
    """(cluster, ky, place): from the most to the least key cluster, ties by number; clusters without a value come last."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("ky"), "cluster")  # the clusters of one model
    return ky.select("cluster", "ky", F.row_number().over(w).alias("place"))


def signed_root_norm(value: str, top: str) -> Column:
    """Place in [-1, 1] of a value on a scale of signed square roots up to ``top``."""
    return F.signum(F.col(value)) * F.sqrt(F.abs(F.try_divide(F.col(value), F.col(top))))


def out_of_range(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows whose value is NaN or lies outside [low, high], as no probability does; NULL is no value."""
    return df.where(F.isnan(value) | (F.col(value) < low) | (F.col(value) > high))


def day_biomass(sim: DataFrame, members: DataFrame, day: int = 20) -> DataFrame:
    """(cid, biomass): mean abundance over draws on a day of the simulation, summed over a cluster's members."""
    per = sim.where(F.col("time") == float(day - 1)).groupBy("taxon").agg(F.avg("x").alias("x"))
    return per.join(members, "taxon").groupBy("cid").agg(F.sum("x").alias("biomass"))


def aggregate_items_like(study: Study, otus: DataFrame) -> DataFrame:
    """(subject, time, otu, raw): the study's reads by another study's OTUs; ``otus`` is (otu, components array).

    A taxon that no OTU holds stands for itself; one that several hold counts in each.
    """
    bridge = otus.select("otu", F.explode("components").alias("taxon")).distinct()
    alone = study.taxa.select(F.col("name").alias("otu"), F.col("name").alias("taxon")).join(bridge.select("taxon"), "taxon", "left_anti")
    return aggregate_items(study, bridge.unionByName(alone))


def consensus_clusters(co: DataFrame, n_items: int, n_clusters: int | Callable[[pd.Series], int], counts: DataFrame, linkage: str = "average") -> DataFrame:
    """(item, cid) from co-clustering shares (a, b, p); ``n_clusters`` may be a function of the draws' cluster counts.

    ``counts`` is (n_clusters, n_draws): a row per different count.  One model's matrix is held at once.
    """
    import numpy as np

    from strandline.operators.kernels import agglomerate

    k = n_clusters
    if callable(n_clusters):
        rows = counts.toPandas()
        k = int(n_clusters(rows["n_clusters"].repeat(rows["n_draws"]).reset_index(drop=True)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.ones((n_items, n_items))
        d[pdf["a"], pdf["b"]] = d[pdf["b"], pdf["a"]] = 1 - pdf["p"]
        np.fill_diagonal(d, 0)
        return pd.DataFrame({"item": np.arange(n_items), "cid": agglomerate(d, linkage, n_clusters=k)})

    return co.groupBy(F.lit("model").alias("m")).applyInPandas(run, "item int, cid int")


def intermediate_points(grid: DataFrame, samples: DataFrame) -> DataFrame:
    """The points of ``grid`` (subject, time) at which the subject has no sample."""
    return grid.join(samples.select("subject", "time"), ["subject", "time"], "left_anti")


def dense(block: DataFrame, rows: list[str], col: str = "col", value: str = "value") -> DataFrame:
    """(rows, values array): a block (rows, col, value) with every row's columns from 0 to the largest, absent ones 0."""
    last = block.agg(F.max(col)).first()[0]
    at = F.map_from_entries(F.collect_list(F.struct(col, value))).alias("m")
    if last is None:
        return block.select(*rows, F.array().cast("array<double>").alias("values"))
    full = F.transform(F.sequence(F.lit(0), F.lit(int(last))), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)))
    return block.groupBy(*rows).agg(at).select(*rows, full.alias("values"))


def all_zero_or_null(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, blank): whether all of a matrix's values are 0, NaN or NULL, so that there is nothing to show."""
    shown = (F.col(value) != 0) & ~F.isnan(value)
    return df.groupBy(*by).agg((F.count_if(shown) == 0).alias("blank"))
