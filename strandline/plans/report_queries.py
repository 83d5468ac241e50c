"""Queries of reports, streams, trees, the study's container and the inference kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.distributions import generator, sample_negbin
from strandline.functions.keys import sample_key
from strandline.inference.data import Observations, Series
from strandline.inference.gibbs import Config
from strandline.inference.run import calibrate_noise, infer
from strandline.operators import kernels as K
from strandline.operators import posterior as P
from strandline.operators import trees as T
from strandline.operators.study import LEVELS
from strandline.plans import posterior_queries as PQ
from strandline.plans.kernel_queries import ORACLE as _O
from strandline.plans.kernel_queries import QUERIES as _Q
from strandline.plans.kernel_queries import plain, study, traces
from strandline.session import durable, read_table
from strandline.streaming.monitor import event_windows, sessions

_before = set(_Q)

# ---------------------------------------------------------------- streams on tables


@plain("select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as \"end\", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2, 3")
def st_daily_windows(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(read_table(spark, d, "events")).withColumn("total", F.round("total", 4))


@plain("""select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) n from (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from
  (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end new from events)) group by user_id, k""")
def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(read_table(spark, d, "events"))


# ---------------------------------------------------------------- trees: the lineages as one tree


def _lineage_tree(s) -> DataFrame:
    """tree_nodes of the taxonomy: a node per lineage prefix and a leaf per taxon, every branch of length 1."""
    cols = [*LEVELS[:6], "name"]
    prefix = [F.concat_ws("|", *cols[: i + 1]) for i in range(len(cols))]
    path = s.taxa.select(F.array(F.lit("root"), *prefix).alias("p"), "name")
    step = path.select(F.explode(F.sequence(F.lit(2), F.size("p"))).alias("i"), "p", "name").select(F.element_at("p", F.col("i")).alias("id"), F.element_at("p", F.col("i") - 1).alias("up"), (F.col("i") == F.size("p")).alias("leaf"), "name").distinct()
    step = step.groupBy("id", "up").agg(F.max("leaf").alias("leaf"), F.max(F.when(F.col("leaf"), F.col("name"))).alias("name"))
    nodes = step.select(F.xxhash64("id").alias("node"), F.xxhash64("up").alias("parent"), "name", F.lit(1.0).alias("length"), "leaf")
    root = s.taxa.sparkSession.range(1).select(F.xxhash64(F.lit("root")).alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("length"), F.lit(False).alias("leaf"))
    return root.unionByName(nodes)


_PRE = [f"""concat_ws('|', {', '.join(f'"{c}"' for c in LEVELS[: i + 1])})""" for i in range(6)]


@study(f"select name as leaf, {_PRE[2]} as top from taxa")
def c23_coarsen(s):
    """Leaves under their ancestor at depth 3: the class."""
    nodes = _lineage_tree(s)
    grp = T.coarsen(nodes, 3.0)
    label = s.taxa.select(F.xxhash64(F.concat_ws("|", *LEVELS[:3])).alias("grp"), F.concat_ws("|", *LEVELS[:3]).alias("top")).distinct()
    return grp.join(label, "grp").select("leaf", "top")


_SAME = " + ".join("case when " + " and ".join(f'x."{c}" = y."{c}"' for c in LEVELS[: i + 1]) + " then 1 else 0 end" for i in range(6))


@study(f"select x.name a, y.name b, 2.0 * (7 - ({_SAME})) dist from taxa x join taxa y on x.name < y.name")
def g11_leaf_distances(s):
    """Path lengths between all taxa."""
    return T.leaf_distances(_lineage_tree(s), s.taxa.select("name"))


@study(f""", d as (select x.name item, y.name ref, 2.0 * (7 - ({_SAME})) dist from taxa x join taxa y on x.name <> y.name),
r as materialized (select *, greatest(0, ceil((dist / 4 - 1) / 0.25 - 1e-9)) k from d where dist <= 11),
n as (select item, s, count(*) c from r, unnest(range(8)) t(s) where k <= s group by 1, 2),
l as (select item, coalesce(min(case when c > 5 then s end), 7) least from n group by 1)
select item, ref, dist, 1 + least * 0.25 multiplier from r join l using (item) where k <= least""")
def k7_reference_leaves(s):
    """References of every taxon, among all taxa, within widening radii."""
    return T.widened_references(_lineage_tree(s), s.taxa.select(F.col("name").alias("item"), F.lit(4.0).alias("radius")))


# ---------------------------------------------------------------- reports


@traces("select 'growth' as var, idx, round(avg(value), 6) mean, round(quantile_cont(value, 0.25), 6) p25, round(median(value), 6) median, round(quantile_cont(value, 0.75), 6) p75 from growth group by 2 union all select 'all growth', null, round(avg(value), 6), round(quantile_cont(value, 0.25), 6), round(median(value), 6), round(quantile_cont(value, 0.75), 6) from growth")
def r2_growth_values(t):
    per = P.summary(t.growth, ["idx"]).withColumn("var", F.lit("growth"))
    every = P.summary(t.growth.withColumn("var", F.lit("all growth")), ["var"]).withColumn("idx", F.lit(None).cast("int"))
    return PQ.rounded(per.unionByName(every), "mean", "p25", "median", "p75")


@traces("select chain, gibbs, " + ", ".join(f"max(case when item = {i} then cid end) item{i}" for i in range(8)) + " from assign group by 1, 2")
def r3_assignments(t):
    return t.assign.groupBy("chain", "gibbs").agg(*[F.max(F.when(F.col("item") == i, F.col("cid"))).alias(f"item{i}") for i in range(8)])


@traces("select tgt, " + ", ".join(f"max(case when src = {i} then bf end) s{i}" for i in range(8)) + " from (" + PQ._BF + ") group by 1")
def r5_bayes_matrix(t):
    bf = PQ.rounded(P.bayes_factors(t.edge, ["tgt", "src"], 1.0, 4.0), "bf")
    return bf.groupBy("tgt").agg(*[F.max(F.when(F.col("src") == i, F.col("bf"))).alias(f"s{i}") for i in range(8)])


@traces("select src item, round(coalesce(avg(value), 0), 6) mean, round(coalesce(median(value), 0), 6) median, count(value) n_on from edge where tgt = 0 group by 1")
def r6_perturbation_values(t):
    rows = t.edge.where("tgt = 0")
    return rows.groupBy(F.col("src").alias("item")).agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.median("value"), F.lit(0.0)), 6).alias("median"), F.count("value").alias("n_on"))


@traces(", ch as (select chain, idx, gibbs, case when floor(value * 20) <> lag(floor(value * 20)) over (partition by chain, idx order by gibbs) then 1 else 0 end c from growth) select chain, idx, round((1.0 + sum(c)) / count(*), 6) rate from ch group by 1, 2")
def r7_acceptance(t):
    cell = F.floor(F.col("value") * 20)
    w = Window.partitionBy("chain", "idx").orderBy("gibbs")
    rows = t.growth.withColumn("cell", cell).withColumn("c", F.coalesce((F.col("cell") != F.lag("cell").over(w)).cast("int"), F.lit(0)))
    return rows.groupBy("chain", "idx").agg(F.round((1 + F.sum("c")) / F.count(F.lit(1)), 6).alias("rate"))


@study("select subject, time, phylum, round(sum(rel), 6) rel from ab join (select idx, phylum from taxa) t on t.idx = taxon_idx where rel is not null group by 1, 2, 3")
def r8_taxonomic_distribution(s):
    t = s.taxa.select(F.col("idx").alias("taxon_idx"), "phylum")
    return s.abundance.where("rel is not null").join(t, "taxon_idx").groupBy("subject", "time", "phylum").agg(F.round(F.sum("rel"), 6).alias("rel"))


@study("select subject, time, count(*) filter (raw > 0) richness, round(log10(max(biomass)), 6) log_biomass from ab group by 1, 2")
def l11_plot_subjects(s):
    """What the subject plots show: richness and biomass over time."""
    return s.abundance.groupBy("subject", "time").agg(F.count_if(F.col("raw") > 0).alias("richness"), F.round(F.log10(F.max("biomass")), 6).alias("log_biomass"))


@study("select a.taxon_idx, count(*) n_samples, cast(sum(a.raw) as bigint) total from cells a where a.subject in (select subject from perts where name = 'cold stress') group by 1")
def y2_perturbed_subjects(s):
    who = s.perts.where("name = 'cold stress'").select("subject").distinct()
    return s.cells.join(who, "subject", "left_semi").groupBy("taxon_idx").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("raw").alias("total"))


@study("select idx, name from taxa where name = 'ASV_00000001' or idx = 10")
def y4_taxa_lookup(s):
    return s.taxa.where((F.col("name") == "ASV_00000001") | (F.col("idx") == 10)).select("idx", "name")


@study("select genus, max(len) longest, min(name) first_name from (select genus, name, length(\"sequence\") len from taxa) group by 1")
def u2_user_naming(s):
    """A user's naming function as an aggregate Column."""
    return s.taxa.groupBy("genus").agg(F.max(F.length("sequence")).alias("longest"), F.min("name").alias("first_name"))


@study("select subject, time, round(1 - sum(p * p), 6) simpson from (select subject, time, raw / sum(raw) over (partition by sample_id) p from cells where raw > 0) group by 1, 2")
def u1_user_diversity(s):
    """A user's diversity metric over the counts of each sample."""
    p = F.col("raw") / F.sum("raw").over(Window.partitionBy("sample_id"))
    return s.cells.where("raw > 0").withColumn("p", p).groupBy("subject", "time").agg(F.round(1 - F.sum(F.col("p") * F.col("p")), 6).alias("simpson"))


@plain("select upper(trim(name)) as key_form, count(*) n from perturbations group by 1")
def c4_key_forms(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "perturbations").groupBy(sample_key("name").alias("key_form")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- inference: the system with known truth


def _synthetic(seed: int = 5) -> Observations:
    s, rng = K.synthetic_system(), generator(seed, "observations")
    series = []
    for j in range(3):
        times = np.arange(0, 40, 2.0)
        x = K.simulate_batch(rng.uniform(0.5, 2, 13), s["growth"][None], s["interactions"][None], 0.1, 40.0, keep=np.rint(times / 0.1).astype(int), noise=0.001, rng=rng)[0]
        reads, q = K.measure(x, 1e-10, 0.01, 0.05, 50_000, rng)
        series.append(Series(f"s{j}", times, reads, list(np.log(q)), np.zeros((len(times) - 1, 0))))
    return Observations([f"TAXA_{i + 1}" for i in range(13)], [], series)


@plain()
def b1_infer(spark: SparkSession, d: str) -> DataFrame:
    """Two chains on the synthetic system: posterior means of growth and self-interaction."""
    trace = infer(spark, _synthetic(), Config(burnin=20, n_samples=40, checkpoint=20, qpcr_scale=0.05, a1=0.01))
    return trace.where("var in ('growth', 'self_interaction') and gibbs >= 20").groupBy("var", "i").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def _observed(s):
    """What inference takes of the study: the most steadily abundant taxa, and the subjects with ten samples or more."""
    from strandline.operators import sequences as Q

    long = s.samples.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("subject")
    samples = s.samples.join(long, "subject", "left_semi")
    cut = s.replace(samples=samples, reads=s.reads.join(samples, "sample_id", "left_semi"), qpcr=s.qpcr.join(samples, "sample_id", "left_semi"))
    kept = durable(Q.consistent_taxa(cut, "rel", 0.01, 3, 3))  # a few names, asked for by each table of the study
    return cut.keep_taxa(kept.withColumnRenamed("taxon", "name"))


@study()
def b1_infer_study(s):
    """A chain over the study itself, its taxa filtered by consistency: means of growth and self-interaction by taxon."""
    from strandline.inference.data import observe

    spark = s.taxa.sparkSession
    obs = observe(_observed(s))
    trace = infer(spark, obs, Config(burnin=4, n_samples=12, checkpoint=6, qpcr_scale=0.3, clusters="none" if obs.n <= 5 else "sampled"), 2, states=False)
    got = trace.where("var in ('growth', 'self_interaction') and gibbs >= 4")
    return got.groupBy("var", "i").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


@study()
def b16_calibrate_study(s):
    """The read noise from all the study's subjects of two samples or more and all their taxa, each subject's samples as
    replicates of one community."""
    from strandline.inference.data import replicate_reads

    got = calibrate_noise(s.taxa.sparkSession, replicate_reads(s), burnin=50, n_samples=150)
    return got.where("gibbs >= 50").groupBy("var").agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("n"))


@plain()
def b16_calibrate_noise(spark: SparkSession, d: str) -> DataFrame:
    rng = generator(1, "replicates")
    reads = sample_negbin(rng, 20_000 * rng.dirichlet(np.ones(20)), 0.05, (6, 20))
    return calibrate_noise(spark, reads, burnin=100, n_samples=300).where("gibbs >= 100").groupBy("var").agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("n"))


QUERIES = {k: _Q.pop(k) for k in list(_Q) if k not in _before}
ORACLE = {k: _O.pop(k) for k in list(_O) if k in QUERIES}
