"""Posterior analytics over trace tables: summaries, Bayes factors, convergence, clusters, networks.

Traces are long: a NULL value means an indicator that is off.  The sampler stores no row for those; with the number of
draws given (``draws``, or ``lengths`` per chain) such sparse traces and dense ones give the same answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.relational import average_rank


def section(trace: DataFrame, burnin: int, part: str = "posterior") -> DataFrame:
    """The draws of 'posterior', 'burnin' or 'entire'; a range filter on gibbs, pushed to the scan."""
    if part == "entire":
        return trace
    return trace.where(F.col("gibbs") >= burnin) if part == "posterior" else trace.where(F.col("gibbs") < burnin)


def summary(trace: DataFrame, by: list[str], value: str = "value", nan_to_zero: bool = False, draws: int | None = None) -> DataFrame:
    """mean, median, p25, p75 per key over the values that are on; with ``nan_to_zero`` off counts as 0.

    With ``draws`` every key counts that many draws, those without a row as 0.
    """
    rows = trace.select(*by, F.col(value).alias("_x"), F.lit(1).cast("bigint").alias("_f"))
    if draws is not None:
        rows = rows.where("_x is not null")
        off = rows.groupBy(*by).agg((F.lit(draws) - F.count(F.lit(1))).alias("_f")).where("_f > 0")
        rows = rows.unionByName(off.select(*by, F.lit(0.0).alias("_x"), "_f"))
    elif nan_to_zero:
        rows = rows.withColumn("_x", F.coalesce("_x", F.lit(0.0)))
    n = F.sum(F.when(F.col("_x").isNotNull(), F.col("_f")))
    shares = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    got = rows.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_f")) / n).alias("mean"), F.percentile(F.col("_x"), shares, F.col("_f")).alias("p"))
    zero = F.lit(0.0)
    return got.select(*by, F.coalesce("mean", zero).alias("mean"), *[F.coalesce(F.col("p")[i], zero).alias(n) for i, n in enumerate(("p25", "median", "p75"))])


def quantiles(trace: DataFrame, by: list[str], probabilities: list[float], value: str = "value") -> DataFrame:
    got = trace.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, probabilities))).alias("p"))
    return got.select(*by, *[F.col("p")[i].alias(f"q{str(q).replace('.', '_')}") for i, q in enumerate(probabilities)])


def bayes_factors(trace: DataFrame, by: list[str], a: float, b: float, value: str = "value", draws: int | None = None) -> DataFrame:
    """(by, n_on, n_off, bf): (on * b) / (off * a); infinite where nothing is off.

    ``draws`` counts the draws of a sparse trace; without it every draw must have a row.
    """
    every = F.count(F.lit(1)) if draws is None else F.lit(draws).cast("bigint")
    got = trace.groupBy(*by).agg(F.count(value).alias("n_on"), (every - F.count(value)).alias("n_off"))
    return got.withColumn("bf", F.when(F.col("n_off") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("n_on") * b, F.col("n_off") * a)))


def degrees(edges: DataFrame) -> DataFrame:
    """(chain, gibbs, item, n_in, n_out) over the edges that are on."""
    on = edges.where("value is not null")
    ends = on.select("chain", "gibbs", F.explode(F.array(F.struct(F.col("tgt").alias("item"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("item"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("chain", "gibbs", F.col("e.item").alias("item")).agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def sign_majority(edges: DataFrame) -> DataFrame:
    """(tgt, src, sign): sum of the signs over all draws."""
    return edges.groupBy("tgt", "src").agg(F.sum(F.signum(F.coalesce("value", F.lit(0.0)))).cast("bigint").alias("sign"))


def coclusters(assign: DataFrame) -> DataFrame:
    """(a, b, p), a < b: how often two items share a cluster.  One array of members per draw and cluster."""
    draws = assign.select("chain", "gibbs").distinct().agg(F.count(F.lit(1)).alias("n"))
    groups = assign.groupBy("chain", "gibbs", "cid").agg(F.array_sort(F.collect_list("item")).alias("m"))  # an item once: bounded by the taxa
    pairs = groups.select(F.posexplode("m").alias("k", "a"), "m").select("a", F.explode(F.slice("m", F.col("k") + 2, F.size("m"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).join(draws).select("a", "b", (F.col("c") / F.col("n")).alias("p"))


def cluster_count_mode(assign: DataFrame) -> DataFrame:
    """(n_clusters, n_draws): the most frequent number of clusters, the smallest on ties."""
    per = assign.groupBy("chain", "gibbs").agg(F.count_distinct("cid").alias("n_clusters"))
    return per.groupBy("n_clusters").agg(F.count(F.lit(1)).alias("n_draws")).orderBy(F.desc("n_draws"), "n_clusters").limit(1)


def canonical_labels(assign: DataFrame, part: list[str]) -> DataFrame:
    """Clusters numbered from 0 by their smallest item."""
    low = F.min("item").over(Window.partitionBy(*part, "cid"))
    return assign.withColumn("low", low).withColumn("label", F.dense_rank().over(Window.partitionBy(*part).orderBy("low")) - 1).drop("low")


def variation_of_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """(vi) between two partitions of the rows, from the contingency table and its margins."""
    n = F.count(F.lit(1))
    cells = df.groupBy(x, y).agg(n.alias("c"))
    r = F.col("c")
    px, py = F.sum("c").over(Window.partitionBy(x)), F.sum("c").over(Window.partitionBy(y))
    cells = cells.withColumn("px", px).withColumn("py", py)
    total = cells.agg(F.sum("c").alias("n"))
    return cells.join(total).agg(F.abs(F.sum(r / F.col("n") * (F.ln(r / F.col("px")) + F.ln(r / F.col("py"))))).alias("vi"))


def chain_moments(trace: DataFrame, by: list[str], value: str = "value", lengths: DataFrame | None = None) -> DataFrame:
    """(chain, by, n, m, s2) with NULL as 0; ``lengths`` (chain, n) counts draws that a sparse trace has no row for."""
    x = F.coalesce(F.col(value), F.lit(0.0))
    got = trace.groupBy("chain", *by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("s2"), F.var_pop(x).alias("_v"))
    if lengths is None:
        return got.drop("_v")
    chains = [F.struct(F.lit(r["chain"]).alias("c"), F.lit(r["n"]).cast("bigint").alias("n")) for r in lengths.collect()]  # a row a chain
    every = trace.select(*by).distinct().select(*by, F.explode(F.array(*chains)).alias("z")).select(*by, F.col("z.c").alias("_c"), F.col("z.n").alias("_n"))
    same = F.col("chain") == F.col("_c")
    for k in by:
        got = got.withColumnRenamed(k, f"_k_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    k, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0.0))
    mean = k * m / F.col("_n")
    squares = k * F.coalesce("_v", F.lit(0.0)) + k * (m - mean) * (m - mean) + (F.col("_n") - k) * mean * mean
    return every.join(got, same, "left").select(F.col("_c").alias("chain"), *by, F.col("_n").alias("n"), mean.alias("m"), F.try_divide(squares, F.col("_n") - 1).alias("s2"))


def r_hat(trace: DataFrame, by: list[str], value: str = "value", lengths: DataFrame | None = None) -> DataFrame:
    """(by, w, b, rhat): Brooks and Gelman's, with the degrees-of-freedom correction; NULL counts as 0.

    Chains are taken at the length of the shortest one's count in the formula; they should be of one length.
    ``lengths`` (chain, n) counts the draws of a sparse trace.
    """
    m = chain_moments(trace, by, value, lengths)
    sq = F.col("m") * F.col("m")
    got = m.groupBy(*by).agg(
        F.min("n").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.avg("s2").alias("w"), F.var_samp("m").alias("vm"), F.avg("m").alias("xbar"),
        F.var_pop("s2").alias("vs"), F.covar_samp("s2", sq).alias("c2"), F.covar_samp("s2", "m").alias("c1"),
    )
    n, k, w = F.col("n"), F.col("k"), F.col("w")
    b = n * F.col("vm")
    v = (n - 1) / n * w + b / n + b / (n * k)
    var_v = ((n - 1) / n) * ((n - 1) / n) / k * F.col("vs") + ((k + 1) / (k * n)) * ((k + 1) / (k * n)) * (F.lit(2.0) / (k - 1)) * b * b + 2 * (k + 1) * (n - 1) / (k * k * n) * (F.col("c2") - 2 * F.col("xbar") * F.col("c1"))
    got = got.withColumn("b", b).withColumn("v", v).withColumn("var_v", var_v)
    dof = F.try_divide(2 * F.col("v") * F.col("v"), F.col("var_v"))
    rh = F.sqrt(F.col("v") * (F.col("dof") + 3) / (w * (F.col("dof") + 1)))
    return got.withColumn("dof", dof).select(*by, "w", "b", rh.alias("rhat"))


def split_r_hat(trace: DataFrame, by: list[str], lengths: DataFrame, value: str = "value") -> DataFrame:
    """(by, rhat): each chain halved, an odd last draw dropped; ``lengths`` is (chain, n).

    Draws without a row count as 0, so sparse traces are taken as they are.
    """
    half = F.floor(F.col("len") / 2)
    rows = trace.join(lengths.withColumnRenamed("n", "len"), "chain").where(F.col("gibbs") < 2 * half)
    rows = rows.withColumn("chain", F.col("chain") * 2 + (F.col("gibbs") >= half).cast("int"))
    halves = lengths.select(F.explode(F.array(F.col("chain") * 2, F.col("chain") * 2 + 1)).alias("chain"), F.floor(F.col("n") / 2).alias("n"))
    m = chain_moments(rows, by, value, halves).groupBy(*by).agg(F.min("n").cast("double").alias("n"), F.avg("s2").alias("w"), F.var_samp("m").alias("vm"))
    return m.select(*by, F.sqrt(((1 - 1 / F.col("n")) * F.col("w") + F.col("vm")) / F.col("w")).alias("rhat"))


def roc_auc(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """(by, auc) from average ranks: (rank sum of the positives - P(P+1)/2) / (P N)."""
    y = F.col(truth).cast("int")
    r = df.withColumn("_r", average_rank(score, by))
    got = r.groupBy(*by).agg(F.sum(F.when(y == 1, F.col("_r"))).alias("s"), F.sum(y).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    return got.select(*by, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def errors(df: DataFrame, pred: str, truth: str, by: list[str]) -> DataFrame:
    """(by, rmse, rel_rmse, pe, log_pe); pairs with a NULL are left out, truth 0 is left out of the relative ones."""
    p, t = F.col(pred), F.col(truth)
    d = p - t
    rel = F.try_divide(d, t)
    return df.where(p.isNotNull() & t.isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(rel * rel)).alias("rel_rmse"), F.avg(F.abs(rel)).alias("pe"), F.avg(F.when((p > 0) & (t > 0), F.abs(F.ln(p) - F.ln(t)))).alias("log_pe"),
    )


def product_of_gaussians(df: DataFrame, by: list[str], mean: str, var: str) -> DataFrame:
    """(by, mean, var) of the product density, in one order-free aggregate."""
    w = F.sum(1 / F.col(var))
    return df.groupBy(*by).agg((F.sum(F.col(mean) / F.col(var)) / w).alias("mean"), (1 / w).alias("var"))


def representative_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Item-level edges condensed to clusters through each cluster's smallest item; self-edges are dropped."""
    rep = members.groupBy("cid").agg(F.min("item").alias("rep"))
    t, s = rep.select(F.col("rep").alias("tgt"), F.col("cid").alias("tgt_cid")), rep.select(F.col("rep").alias("src"), F.col("cid").alias("src_cid"))
    return edges.join(t, "tgt").join(s, "src").where("tgt_cid <> src_cid")


def expand_edges(cluster_edges: DataFrame, members: DataFrame) -> DataFrame:
    """Cluster-level edges to items: membership joined on both sides."""
    t, s = members.select(F.col("item").alias("tgt"), F.col("cid").alias("tgt_cid")), members.select(F.col("item").alias("src"), F.col("cid").alias("src_cid"))
    return cluster_edges.join(t, "tgt_cid").join(s, "src_cid")


def network_json(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, json): nodes (id, size) and edges (source, target, weight, sign, bayes_fac, bend) of a network view.

    Edges of weight or Bayes factor 0 are none; ``bend`` says that the reverse edge exists.
    """
    e = edges.where("bf > 0 and weight <> 0")
    back = e.select(F.col("src").alias("tgt"), F.col("tgt").alias("src"), F.lit(True).alias("bend"))
    e = e.join(back, ["tgt", "src"], "left")
    edge = F.to_json(F.struct(F.struct(F.col("src").alias("source"), F.col("tgt").alias("target"), F.round("weight", 6).alias("weight"), F.col("sign"), F.round("bf", 6).alias("bayes_fac"), F.coalesce("bend", F.lit(False)).alias("bend")).alias("data")))
    node = F.to_json(F.struct(F.struct(F.col("id"), F.col("size")).alias("data")))
    return nodes.select(F.lit("node").alias("kind"), node.alias("json")).unionByName(e.select(F.lit("edge").alias("kind"), edge.alias("json")))


def keystoneness(sim: DataFrame, members: DataFrame, pseudo: float = 1e5) -> DataFrame:
    """(cluster, ky): mean over samples of the mean over non-members of log10(baseline) - log10(cluster excluded).

    ``sim`` is (scenario, gibbs, taxon, x) with scenario NULL for the baseline; means are taken in two levels, as the
    groups differ in size.
    """
    log = F.log10(F.col("x") + pseudo)
    base = sim.where("scenario is null").select("gibbs", "taxon", log.alias("base"))
    alt = sim.where("scenario is not null").select(F.col("scenario").alias("cluster"), "gibbs", "taxon", log.alias("alt"))
    outside = alt.join(members.select(F.col("cid").alias("cluster"), "taxon"), ["cluster", "taxon"], "left_anti")
    per = outside.join(base, ["gibbs", "taxon"]).groupBy("cluster", "gibbs").agg(F.avg(F.col("base") - F.col("alt")).alias("d"))
    return per.groupBy("cluster").agg(F.avg("d").alias("ky"))


def cluster_abundance_medians(sim: DataFrame, members: DataFrame) -> DataFrame:
    """(scenario, cid, median) of the cluster sums over samples, baseline included."""
    sums = sim.join(members, "taxon").groupBy("scenario", "cid", "gibbs").agg(F.sum("x").alias("x"))
    return sums.groupBy("scenario", "cid").agg(F.median("x").alias("median"))


def denormalise(trace: DataFrame, power: dict[str, int], factor: float) -> DataFrame:
    """Values times factor to the power of their variable; variables not named stay."""
    table = F.create_map(*[F.lit(x) for kv in power.items() for x in (kv[0], float(factor) ** kv[1])])
    return trace.withColumn("value", F.col("value") * F.coalesce(F.element_at(table, F.col("var")), F.lit(1.0)))
