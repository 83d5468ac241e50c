"""Command line: python -m strandline COMMAND ...  Tables in, tables out; figures are left to whoever reads them."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.operators import kernels as K
from strandline.operators import posterior as P
from strandline.operators import relational as R
from strandline.operators import sequences as Q
from strandline.operators import trees as T
from strandline.sources import tables as S

LOG = logging.getLogger("strandline")


def _study(a, spark):
    return S.load_study(spark, a.study)


def parse_input(a, spark):
    """Five TSV tables to a study."""
    S.save_study(S.read_study(spark, a.folder, a.sep), a.out)


def filter_taxa(a, spark):
    """Keeps taxa that are consistently abundant, and at most --max-n-taxa of them."""
    s = _study(a, spark)
    kept = Q.consistent_taxa(s, a.dtype, a.threshold, a.min_num_consecutive, a.min_num_subjects, a.colonization_time)
    if a.other:
        kept = kept.union(Q.consistent_taxa(S.load_study(spark, a.other), a.dtype, a.threshold, a.min_num_consecutive, a.min_num_subjects, a.colonization_time)).distinct()
    s = s.keep_taxa(kept.withColumnRenamed("taxon", "name"))
    if a.max_n_taxa:
        s = S.make_toy(s, a.max_n_taxa)
    S.save_study(s, a.out)


def infer_negbin(a, spark):
    """Calibrates the read noise from the samples of replicate subjects."""
    from strandline.inference.run import calibrate_noise

    from strandline.inference.data import replicate_reads

    groups = replicate_reads(_study(a, spark))  # one matrix a subject: its samples are replicates of one community
    calibrate_noise(spark, groups, a.seed, a.chains, a.burnin, a.n_samples).write.mode("overwrite").parquet(a.out)


def infer(a, spark):
    """Runs the chains, each block of draws committed to the trace; the same call goes on with a run that broke off."""
    from strandline.inference.data import observe
    from strandline.inference.gibbs import Config
    from strandline.inference.run import infer_to

    obs = observe(_study(a, spark))
    clusters = "none" if a.nomodules or obs.n <= a.singletons_up_to else "sampled"
    fixed: tuple[int, ...] = ()
    if a.fixed_clustering:
        table = S.read_clustering(spark, a.fixed_clustering)
        clusters, fixed = "fixed", S.clustering_of(table, obs.taxa)
    a0, a1 = _noise(spark, a.negbin)
    cfg = Config(seed=a.seed, burnin=a.burnin, n_samples=a.n_samples, checkpoint=a.checkpoint, a0=a0, a1=a1, clusters=clusters, fixed=fixed)
    infer_to(spark, obs, cfg, a.out, a.chains)


def _noise(spark, given):
    """a0 and a1 of two numbers, or the posterior means of a calibration's trace."""
    if len(given) == 2:
        return float(given[0]), float(given[1])
    if len(given) != 1:
        raise ValueError("--negbin takes a0 and a1, or the folder of a calibration")
    mean = {r["var"]: r["m"] for r in spark.read.parquet(given[0]).groupBy("var").agg(F.avg("value").alias("m")).collect()}
    return mean["a0"], mean["a1"]


def _edges(trace):
    return trace.where("var = 'interaction'").select("chain", "gibbs", F.col("i").alias("tgt"), F.col("j").alias("src"), "value")


def _draws(trace):
    return trace.where("var = 'growth' and i = 0").groupBy("chain").agg((F.max("gibbs") + 1).alias("n"))


def extract_posterior(a, spark):
    """Summaries, split R-hat, Bayes factors and co-clusters of a trace, a table each."""
    trace = P.section(spark.read.parquet(a.trace).where("var <> 'state'"), a.burnin)
    vector = trace.where("var in ('growth', 'self_interaction')")
    scalar = trace.where("i is null")
    lengths = _draws(trace).withColumn("n", F.col("n") - a.burnin)
    n = sum(r["n"] for r in lengths.collect())  # a row a chain; edges and perturbations that are off have no row
    late = lambda t: t.withColumn("gibbs", F.col("gibbs") - a.burnin)
    edges = _edges(trace)
    effects = trace.where("var = 'perturbation'").select("chain", "gibbs", F.col("i").alias("item"), F.col("j").alias("pert"), "value")
    out = {
        "vectors": P.summary(vector, ["var", "i"]), "scalars": P.summary(scalar, ["var"]), "edges": P.summary(edges, ["tgt", "src"], draws=n),
        "perturbations": P.summary(effects, ["item", "pert"], draws=n),
        "scalars_rhat": P.split_r_hat(late(scalar), ["var"], lengths), "vectors_rhat": P.split_r_hat(late(vector), ["var", "i"], lengths),
        "edges_rhat": P.split_r_hat(late(edges), ["tgt", "src"], lengths), "perturbations_rhat": P.split_r_hat(late(effects), ["item", "pert"], lengths),
        "coclusters": P.coclusters(trace.where("var = 'cluster'").select("chain", "gibbs", F.col("i").alias("item"), F.col("value").cast("bigint").alias("cid"))),
        "bayes_factors": P.bayes_factors(edges, ["tgt", "src"], a.prior_a, a.prior_b, draws=n),
        "perturbation_bayes_factors": P.bayes_factors(effects, ["item", "pert"], a.prior_a, a.prior_b, draws=n),
    }
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")


def extract_abundances(a, spark):
    """Mean abundances over subjects at one time, as two columns."""
    s = _study(a, spark)
    got = R.aggregate_over_subjects(s, a.dtype, "mean", "union").where(F.abs(F.col("time") - a.time) < 1e-9)
    named = got.join(s.taxa.select(F.col("idx").alias("taxon_idx"), "name"), "taxon_idx").select("name", F.greatest("value", F.lit(a.limit_of_detection)))
    S.write_tsv(named, a.out, header=False)


def _params(trace):
    cols = ["chain", "gibbs", F.col("i").alias("idx"), "value"]
    effects = trace.where("var = 'perturbation'").select(*cols, F.col("j").alias("pert"))
    return K.draws(trace.where("var = 'growth'").select(*cols), trace.where("var = 'self_interaction'").select(*cols), _edges(trace), effects)


def _windows(study, subject):
    """(perturbation, start, end) of a subject; perturbations count by their name's order among all, as in the trace."""
    names = sorted(r["name"] for r in study.perts.select("name").distinct().collect())  # a row a perturbation
    mine = study.perts.where(F.col("subject") == subject).orderBy("start", "end").collect()  # of one subject
    return [(names.index(r["name"]), float(r["start"]), float(r["end"])) for r in mine]


def _initial(a, spark):
    rows = S.read_initial_conditions(spark, a.initial, _study(a, spark).taxa).orderBy("idx").collect()
    return [max(r["abundance"], a.limit_of_detection) for r in rows]


def forward_simulate(a, spark):
    """Trajectories of every posterior draw; with --subject, under that subject's perturbations."""
    import numpy as np

    trace = P.section(spark.read.parquet(a.trace).where("var <> 'state'"), a.burnin)
    windows = _windows(_study(a, spark), a.subject) if a.subject else []
    K.forward_simulate(_params(trace), np.array(_initial(a, spark)), a.dt, a.n_days, ceiling=a.sim_max, noise=a.noise, windows=windows).write.mode("overwrite").parquet(a.out)


def evaluate_keystoneness(a, spark):
    """Keystoneness of every cluster of an assignment table (item, cid)."""
    import numpy as np

    trace = P.section(spark.read.parquet(a.trace).where("var <> 'state'"), a.burnin)
    members = spark.read.parquet(a.clusters).select(F.col("item").cast("int").alias("taxon"), F.col("cid").cast("int").alias("cid"))
    gone: dict[int, list[int]] = {}
    for r in members.collect():  # one row per taxon of the model
        gone.setdefault(r["cid"], []).append(r["taxon"])
    steady = K.steady_states(_params(trace), np.array(_initial(a, spark)), a.dt, a.n_days, gone, a.sim_max)
    sim = steady.select("scenario", F.struct("chain", "gibbs").alias("gibbs"), "taxon", "x")
    P.keystoneness(sim, members).write.mode("overwrite").parquet(a.out)


def visualize_posterior(a, spark):
    """The tables behind the posterior figures."""
    extract_posterior(a, spark)


def visualize_negbin(a, spark):
    """Summaries of the noise calibration."""
    P.summary(P.section(spark.read.parquet(a.trace), a.burnin), ["var"]).write.mode("overwrite").parquet(a.out)


def plot_subjects(a, spark):
    """Relative abundance by level and biomass over time."""
    s = _study(a, spark)
    R.cluster_by_level(s, "rel", a.level).write.mode("overwrite").parquet(f"{a.out}/abundance")
    s.biomass.join(s.samples, "sample_id").write.mode("overwrite").parquet(f"{a.out}/biomass")


def interaction_to_cytoscape(a, spark):
    """Nodes and edges of the interaction network as JSON lines."""
    trace = P.section(spark.read.parquet(a.trace).where("var <> 'state'"), a.burnin)
    edges = _edges(trace)
    n = trace.where("var = 'growth' and i = 0").count()
    odds = P.bayes_factors(edges, ["tgt", "src"], a.prior_a, a.prior_b, draws=n)
    weight = edges.groupBy("tgt", "src").agg((F.sum("value") / n).alias("weight"), F.sum(F.signum("value")).cast("bigint").alias("sign"))
    bf = odds.join(weight, ["tgt", "src"])
    nodes = trace.where("var = 'growth'").groupBy(F.col("i").alias("id")).agg(F.lit(1).alias("size"))
    P.network_json(bf, nodes).select("json").write.mode("overwrite").text(a.out)


def render_phylogeny(a, spark):
    """References near each taxon of a study in a newick tree."""
    nodes = T.read_newick(spark, open(a.tree, encoding="utf-8").read())
    leaves = nodes.where("leaf").select("name")
    d = T.leaf_distances(nodes, leaves)
    both = d.select(F.col("a").alias("item"), F.col("b").alias("ref"), "dist").union(d.select("b", "a", "dist"))
    items = _study(a, spark).taxa.select(F.col("name").alias("item"))
    both = both.join(items, "item", "left_semi").join(items.withColumnRenamed("item", "ref"), "ref", "left_anti")
    T.reference_leaves(both, items.withColumn("radius", F.lit(a.radius))).write.mode("overwrite").parquet(a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name, f, *args):
        c = sub.add_parser(name, help=f.__doc__)
        for flag, kw in args:
            c.add_argument(flag, **kw)
        c.add_argument("--out", required=True)
        c.set_defaults(run=f)

    need, num, count = {"required": True}, lambda d: {"type": float, "default": d}, lambda d: {"type": int, "default": d}
    study, trace = ("--study", need), ("--trace", need)
    run = [("--seed", count(0)), ("--chains", count(2)), ("--burnin", count(100)), ("--n-samples", count(200))]
    sim = [("--initial", need), ("--dt", num(0.01)), ("--n-days", num(180.0)), ("--sim-max", num(1e20)), ("--limit-of-detection", num(1e5)), ("--burnin", count(0))]
    post = [trace, ("--burnin", count(0)), ("--prior-a", num(0.5)), ("--prior-b", num(1.0))]
    command("parse-input", parse_input, ("--folder", need), ("--sep", {"default": "\t"}))
    command("filter", filter_taxa, study, ("--other", {}), ("--dtype", {"default": "rel", "choices": ["raw", "rel", "abs"]}), ("--threshold", num(1e-4)), ("--min-num-consecutive", count(5)), ("--min-num-subjects", count(1)), ("--colonization-time", num(0.0)), ("--max-n-taxa", count(0)))
    command("infer-negbin", infer_negbin, study, *run)
    command("infer", infer, study, *run, ("--checkpoint", count(50)), ("--negbin", {"nargs": "+", "default": ["1e-10", "0.1"]}), ("--nomodules", {"action": "store_true"}), ("--singletons-up-to", count(30)), ("--fixed-clustering", {}))
    command("extract-posterior", extract_posterior, *post)
    command("extract-abundances", extract_abundances, study, ("--time", {"type": float, "required": True}), ("--dtype", {"default": "abs"}), ("--limit-of-detection", num(1e5)))
    command("forward-simulate", forward_simulate, study, trace, *sim, ("--noise", num(0.0)), ("--subject", {}))
    command("evaluate-keystoneness", evaluate_keystoneness, study, trace, ("--clusters", need), *sim)
    command("visualize-posterior", visualize_posterior, *post)
    command("visualize-negbin", visualize_negbin, trace, ("--burnin", count(0)))
    command("plot-subjects", plot_subjects, study, ("--level", {"default": "family"}))
    command("interaction-to-cytoscape", interaction_to_cytoscape, *post)
    command("render-phylogeny", render_phylogeny, study, ("--tree", need), ("--radius", num(0.1)))
    return p


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    a.run(a, spark)
    LOG.info("wrote %s", a.out)
