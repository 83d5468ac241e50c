"""Queries of the numeric kernels and the design matrices, with SQL wherever a recursion or a join can state them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import distributions as D
from strandline.operators import design as X
from strandline.operators import graphs as G
from strandline.operators import kernels as K
from strandline.operators import posterior as P
from strandline.operators import relational as R
from strandline.plans import posterior_queries as PQ
from strandline.plans import study_queries as SQ
from strandline.session import durable
from strandline.sources.tables import random_taxa

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def study(sql: str | None = None):
    def add(f):
        SQ.study_query(sql)(f)
        QUERIES[f.__name__] = SQ.QUERIES.pop(f.__name__)
        if sql is not None:
            ORACLE[f.__name__] = SQ.ORACLE.pop(f.__name__)
        return f

    return add


def traces(sql: str | None = None):
    def add(f):
        PQ.query(sql)(f)
        QUERIES[f.__name__] = PQ.QUERIES.pop(f.__name__)
        if sql is not None:
            ORACLE[f.__name__] = PQ.ORACLE.pop(f.__name__)
        return f

    return add


def plain(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- dynamics

DT, DAYS, N = 0.1, 2.0, 8
_PARAMS = """, recursive_in as (select chain, gibbs, list(g order by tgt) g, flatten(list(a order by tgt)) a from (select chain, gibbs, tgt, max(case when tgt = src then abs(x) + 0.1 end) g,
  list(case when tgt = src then -abs(x) when abs(x) >= 0.05 then x else 0 end order by src) a from e group by 1, 2, 3) group by 1, 2)"""


def _recursion(start: str, steps: int) -> str:
    """The simulation as a recursive query over arrays."""
    base = PQ.BASE.replace("with v as", "with recursive v as", 1)
    return base + _PARAMS + f""", sim as (select chain, gibbs, g, a, 0 k, {start} x from recursive_in union all
      select chain, gibbs, g, a, k + 1, list_transform(range(1, 9), lambda i: least(1e20, x[i] * exp({DT} * (g[i] + list_sum(list_transform(range(1, 9), lambda j: a[(i - 1) * 8 + j] * x[j]))))))
      from sim where k < {steps})"""


def _params(t):
    diag = t.cells.where("tgt = src").select("chain", "gibbs", F.col("tgt").alias("idx"), F.abs("x").alias("value"))
    return K.draws(t.growth, diag, t.edge)


START = [1.0, 0.5, 0.25, 0.0, 1.0, 0.5, 0.25, 0.125]


@traces()
def d5_forward_simulate(t):
    sim = K.forward_simulate(_params(t), np.array(START), DT, DAYS)
    return sim.select("chain", "gibbs", "time", "taxon", F.round("x", 6).alias("x"))


ORACLE["d5_forward_simulate"] = _recursion(f"{START}::double[]", 20) + " select chain, gibbs, k * 0.1 as time, cast(i - 1 as int) taxon, round(x[i], 6) x from sim, unnest(range(1, 9)) u(i) where k % 10 = 0"

#: (perturbation, start, end) of a subject, on grid times in [start, end); of two that overlap the later counts
_WINDOWS = [(0, 0.5, 1.3), (1, 1.1, 1.5)]


@traces()
def d5_forward_simulate_perturbed(t):
    """Each draw's own effects of two perturbations, the interactions with the next and the next but one item."""
    own = t.cells.where("src = (tgt + 1) % 8 or src = (tgt + 2) % 8").where(F.abs("x") >= PQ.OFF)
    effects = own.select("chain", "gibbs", F.col("tgt").alias("idx"), (F.col("src") != (F.col("tgt") + 1) % 8).cast("int").alias("pert"), F.col("x").alias("value"))
    diag = t.cells.where("tgt = src").select("chain", "gibbs", F.col("tgt").alias("idx"), F.abs("x").alias("value"))
    sim = K.forward_simulate(K.draws(t.growth, diag, t.edge, effects), np.array(START), DT, DAYS, windows=_WINDOWS)
    return sim.select("chain", "gibbs", "time", "taxon", F.round("x", 6).alias("x"))


_EFFECT = "case when abs(a0[(i - 1) * 8 + (i + {0} - 1) % 8 + 1]) >= 0.05 then a0[(i - 1) * 8 + (i + {0} - 1) % 8 + 1] else 0 end"
ORACLE["d5_forward_simulate_perturbed"] = (
    PQ.BASE.replace("with v as", "with recursive v as", 1)
    + _PARAMS
    + f""", raw as (select chain, gibbs, list(x order by tgt, src) a0 from e group by 1, 2),
      pin as (select *, list_transform(range(1, 9), lambda i: {_EFFECT.format(1)}) p0, list_transform(range(1, 9), lambda i: {_EFFECT.format(2)}) p1 from recursive_in join raw using (chain, gibbs)),
      sim as (select chain, gibbs, g, a, p0, p1, 0 k, {START}::double[] x from pin union all
      select chain, gibbs, g, a, p0, p1, k + 1, list_transform(range(1, 9), lambda i: least(1e20, x[i] * exp({DT} * (g[i] * (1 + case when k between 11 and 14 then p1[i] when k between 5 and 12 then p0[i] else 0 end)
        + list_sum(list_transform(range(1, 9), lambda j: a[(i - 1) * 8 + j] * x[j]))))))
      from sim where k < 20) select chain, gibbs, k * 0.1 as time, cast(i - 1 as int) taxon, round(x[i], 6) x from sim, unnest(range(1, 9)) u(i) where k % 10 = 0"""
)

_EX = {0: [0, 3, 6], 1: [1, 4, 7], 2: [2, 5]}


@traces()
def d9_keystoneness_simulated(t):
    """Keystoneness end to end over two days of a coarse grid, a transient that recursive SQL can follow;
    ``d9_keystoneness_steady`` has the production horizon."""
    ky = K.steady_states(_params(t), np.array(START), DT, DAYS, _EX)
    mem = t.growth.select(F.col("idx").alias("taxon"), (F.col("idx") % 3).alias("cid")).distinct()
    # draws are told apart by chain and gibbs together
    sim = ky.select("scenario", (F.col("gibbs") * 4 + F.col("chain")).alias("gibbs"), "taxon", "x")
    return P.keystoneness(sim, mem, 1.0).select("cluster", F.round("ky", 6).alias("ky"))


@traces()
def d9_keystoneness_steady(t):
    """The same at the production horizon and step, 180 days of 0.01, self-interactions strong enough to settle."""
    diag = t.cells.where("tgt = src").select("chain", "gibbs", F.col("tgt").alias("idx"), (F.abs("x") + 1.0).alias("value"))
    edges = t.edge.withColumn("value", F.col("value") / 10)
    ky = K.steady_states(K.draws(t.growth, diag, edges), np.array(START), 0.01, 180.0, _EX)
    mem = t.growth.select(F.col("idx").alias("taxon"), (F.col("idx") % 3).alias("cid")).distinct()
    sim = ky.select("scenario", (F.col("gibbs") * 4 + F.col("chain")).alias("gibbs"), "taxon", "x")
    return P.keystoneness(sim, mem, 1.0).select("cluster", F.round("ky", 6).alias("ky"))


ORACLE["d9_keystoneness_simulated"] = (
    PQ.BASE.replace("with v as", "with recursive v as", 1)
    + _PARAMS
    + ", starts as ("
    + " union all ".join(f"select {'null' if s is None else s}::int sc, {[0.0 if s is not None and i in _EX[s] else v for i, v in enumerate(START)]}::double[] x0" for s in (None, 0, 1, 2))
    + f"""), sim as (select sc, chain, gibbs, g, a, 0 k, x0 x from recursive_in, starts union all
      select sc, chain, gibbs, g, a, k + 1, list_transform(range(1, 9), lambda i: x[i] * exp({DT} * (g[i] + list_sum(list_transform(range(1, 9), lambda j: a[(i - 1) * 8 + j] * x[j]))))) from sim where k < 20),
      st as (select sc, chain, gibbs, i - 1 taxon, avg(x[i]) x from sim, unnest(range(1, 9)) u(i) where k >= 16 group by all),
      d as (select b.sc as cluster, a.chain, a.gibbs, avg(log10(a.x + 1) - log10(b.x + 1)) d from st a join st b on a.sc is null and b.sc is not null and a.chain = b.chain and a.gibbs = b.gibbs and a.taxon = b.taxon where b.taxon % 3 <> b.sc group by all)
      select cluster, round(avg(d), 6) ky from d group by 1"""
)


@traces()
def d4_stability(t):
    """Analytic steady states; SQL has no pseudo-inverse."""
    return K.stability_points(_params(t), N).withColumn("x", F.round("x", 6))


@traces()
def d2_noisy_simulation(t):
    """Multiplicative process noise; its stream depends on chain and draw only."""
    sim = K.forward_simulate(_params(t), np.array(START), DT, DAYS, [0.0, 1.0, 2.0], noise=0.01, seed=7)
    return sim.groupBy("time", "taxon").agg(F.round(F.avg("x"), 6).alias("mean"))


@plain()
def d12_synthetic_trajectories(spark, d):
    """The three-cluster system with known truth, observed for 20 days."""
    s = K.synthetic_system()
    x = K.simulate_batch(np.full(13, 1.0), s["growth"][None], s["interactions"][None], 0.1, 20.0, keep=np.arange(0, 201, 10))[0]
    rows = [(float(k), i, float(v)) for k, row in enumerate(x) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "time double, taxon int, x double")


@plain()
def d13_measurements(spark, d):
    s = K.synthetic_system()
    x = K.simulate_batch(np.full(13, 1.0), s["growth"][None], s["interactions"][None], 0.1, 20.0, keep=np.arange(0, 201, 10))[0]
    reads, _ = K.measure(x, 1e-10, 0.05, 0.1, 50_000, D.generator(3, "noise"))
    return spark.createDataFrame([(float(k), i, int(v)) for k, row in enumerate(reads) for i, v in enumerate(row)], "time double, taxon int, count bigint")


@plain()
def s36_random_taxa(spark, d):
    return random_taxa(spark, 100, seed=1)


# ---------------------------------------------------------------- clustering and smoothing


@traces()
def g2_posterior_clusters(t):
    """Complete-linkage clusters of 1 - co-clustering, as many as the mode of the draws."""
    co = P.coclusters(t.assign).select(F.lit(0).alias("grp"), F.col("a").cast("bigint"), F.col("b").cast("bigint"), (1 - F.col("p")).alias("dist"))
    n = P.cluster_count_mode(t.assign).first()
    return K.cluster_groups(co, "grp", "complete", n["n_clusters"] if n else 1).select("item", "label")


def _sequences(s):
    return s.taxa.where("sequence is not null and sequence <> 'NA'").select(F.col("idx").cast("bigint").alias("id"), F.col("sequence").alias("seq"))


@study("""select a.idx a, b.idx b, cast(d as int) dist from (select a.idx ia, b.idx ib, len(list_filter(range(1, length(a."sequence") + 1), lambda i: a."sequence"[i] <> b."sequence"[i] and a."sequence"[i] <> 'N' and b."sequence"[i] <> 'N')) d
  from taxa a join taxa b on a.idx < b.idx and length(a."sequence") = length(b."sequence") and a."sequence" <> 'NA' and b."sequence" <> 'NA') join taxa a on a.idx = ia join taxa b on b.idx = ib where d <= 10""")
def c7_hamming_neighbours(s):
    return G.hamming_neighbours(_sequences(s), 10).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "dist")


@study()
def g1_otus(s):
    """Taxa joined to OTUs by average linkage of Hamming distances up to 10, one agglomeration per component."""
    seq = durable(_sequences(s))
    # equal sequences are one item of a weight, so that copies are never paired
    one = durable(seq.groupBy("seq").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    near = G.hamming_neighbours(one.select("id", "seq"), 10)
    comp = G.connected_groups(one.select(F.col("id").alias("node")), near.select("a", "b"))
    got = K.cluster_sequences(comp.join(one.hint("merge"), F.col("node") == F.col("id")).select("grp", F.col("id").alias("item"), "seq", "weight"))
    copies = seq.join(one.select("seq", F.col("id").alias("rep")).hint("merge"), "seq").select("id", "rep")
    return got.withColumnRenamed("item", "rep").join(copies.hint("merge"), "rep").select("grp", F.col("id").alias("item"), "label")


@study()
def w7_loess(s):
    rows = s.abundance.where("rel is not null").select("subject", "taxon_idx", "time", "rel")
    return K.loess_series(rows, ["subject", "taxon_idx"], "time", "rel").withColumn("smooth", F.round("smooth", 6))


# ---------------------------------------------------------------- design matrices

_STATE = """, gr as (select subject, time, tidx, taxon_idx, abs, lead(tidx) over w ni, lead(time) over w nt, lead(abs) over w nx from ab where abs > 0 window w as (partition by subject, taxon_idx order by tidx)),
  x as (select subject, tidx, taxon_idx, abs x, (ln(nx) - ln(abs)) / (nt - time) y from gr where ni = tidx + 1),
  ix0 as (select p.subject, p.name, p.start, p."end", min(case when s.time >= p.start then tidx end) a, max(case when s.time <= p."end" then tidx end) z from (select distinct name, subject, start, "end" from perts) p join samples s on s.subject = p.subject group by all),
  ix as (select subject, name pert, a, case when a = z then z + 1 else z end z from ix0 where a <= z),
  act as (select distinct x.subject, x.tidx, x.taxon_idx, pert from x join ix on ix.subject = x.subject and x.tidx >= a and x.tidx < z)"""


@study(_STATE + " select subject, tidx, taxon_idx, round(y, 6) y from x")
def m3_response(s):
    return X.response(s).withColumn("y", F.round("y", 6))


@study(_STATE + " select subject, tidx, taxon_idx, taxon_idx col, round(log10(x), 6) log_size from x")
def m4_self_block(s):
    return X.self_block(X.state(s)).select(*X.ROW, "col", F.round(F.log10(-F.col("value")), 6).alias("log_size"))


@study(_STATE + " select x.subject, x.tidx, x.taxon_idx, x.taxon_idx col, round(coalesce(p, 1), 6) as value from x left join (select subject, tidx, taxon_idx, product(1 + 0.1 * (taxon_idx % 5)) p from act group by 1, 2, 3) using (subject, tidx, taxon_idx)")
def m5_growth_block(s):
    gamma = s.taxa.select(F.col("idx").alias("taxon_idx"), (0.1 * (F.col("idx") % 5)).alias("gamma"))
    slices = X.perturbation_rows(s)
    x = X.state(s)
    hit = X.active_rows(x, slices).join(gamma, "taxon_idx").select(*X.ROW, "pert", "gamma")
    p = hit.groupBy(*X.ROW).agg(F.product(1 + F.col("gamma")).alias("p"))
    return x.join(p, X.ROW, "left").select(*X.ROW, F.col("taxon_idx").alias("col"), F.round(F.coalesce("p", F.lit(1.0)), 6).alias("value"))


@study(_STATE + " select subject, tidx, taxon_idx, pert, taxon_idx col, round(0.1 + 0.01 * (taxon_idx % 7), 6) as value from act")
def m6_perturbation_block(s):
    growth = s.taxa.select(F.col("idx").alias("taxon_idx"), (0.1 + 0.01 * (F.col("idx") % 7)).alias("growth"))
    return X.perturbation_block(X.state(s), X.perturbation_rows(s), growth).withColumn("value", F.round("value", 6))


@study(_STATE + " select a.subject, a.tidx, a.taxon_idx, b.taxon_idx src, round(log10(b.x), 6) log_value from x a join x b on a.subject = b.subject and a.tidx = b.tidx and a.taxon_idx <> b.taxon_idx")
def m7_interaction_base(s):
    return X.interaction_base(X.state(s)).select(*X.ROW, "src", F.round(F.log10("value"), 6).alias("log_value"))


@study(_STATE + " select a.subject, a.tidx, a.taxon_idx, a.taxon_idx % 4 tgt_cid, b.taxon_idx % 4 src_cid, round(log10(sum(b.x)), 6) log_value from x a join x b on a.subject = b.subject and a.tidx = b.tidx and a.taxon_idx % 4 <> b.taxon_idx % 4 group by all")
def m8_mixed_interactions(s):
    members = s.taxa.select(F.col("idx").alias("taxon_idx"), (F.col("idx") % 4).alias("cid"))
    return X.mixed_interactions(X.state(s), members).select(*X.ROW, "tgt_cid", "src_cid", F.round(F.log10("value"), 6).alias("log_value"))


@study(_STATE + " select subject, tidx, taxon_idx, round(y - 0.2, 6) r from x")
def m2_residual(s):
    x = X.state(s)
    ones = x.select(*X.ROW, F.lit(0).alias("col"), F.lit(1.0).alias("value"))
    coef = x.sparkSession.createDataFrame([(0, 0.2)], "col int, b double")
    return X.residual(X.response(s), ones, coef).withColumn("r", F.round("r", 6))


#: ranks less the rank of the zeros, d, so that only cells present together add to a product
_RANKS = """, ns as (select count(*) n from samples),
v as (select taxon_idx t, raw, count(*) c from cells where raw > 0 group by 1, 2),
u as (select *, sum(c) over (partition by t order by raw) upto, sum(c) over (partition by t) total from v),
d as (select t, raw, c, (n - total + 1) / 2.0 r0, n - total + upto - (c - 1) / 2.0 r from u, ns),
m as (select t, sum(c * (r - r0)) s1, sum(c * (r - r0) * (r - r0)) s2 from d group by 1),
k as materialized (select c.sample_id, c.taxon_idx t, d.r - d.r0 x from cells c join d on d.t = c.taxon_idx and d.raw = c.raw),
z as materialized (select a.t a, b.t b, sum(a.x * b.x) xy from k a join k b on a.sample_id = b.sample_id and a.t < b.t group by 1, 2),
w as (select idx t, s1, s2 - s1 * s1 / n ss, n from taxa left join m on m.t = idx cross join ns)
select x.t a, y.t b, round(case when x.s1 is null or y.s1 is null then 1.0 when x.ss > 1e-9 and y.ss > 1e-9 then
  (1 - (coalesce(xy, 0) - x.s1 * y.s1 / x.n) / sqrt(x.ss * y.ss)) / 2 end, 6) dist
from w x join w y on x.t < y.t left join z on z.a = x.t and z.b = y.t"""


@study(_RANKS)
def j10_spearman(s):
    """Distances of all pairs of taxa from rank correlation over all samples."""
    return X.sparse_spearman(s, s.taxa.select(F.col("idx").alias("taxon_idx")), digits=6)


# ---------------------------------------------------------------- densities


@study("select reading_id, round(-0.5 * pow((ln(density) - 20) / 2, 2) - ln(2) - ln(2 * pi()) / 2, 6) normal, round(-0.5 * pow((ln(density) - 20) / 2, 2) - ln(2) - ln(2 * pi()) / 2 - ln(density), 6) lognormal, round(least(1, greatest(0, (ln(density) - 5) / 30)), 6) uniform_cdf from qpcr_c")
def dist_densities(s):
    x = F.ln("density")
    return s.qpcr.select("reading_id", F.round(D.normal_logpdf(x, F.lit(20.0), F.lit(2.0)), 6).alias("normal"), F.round(D.lognormal_logpdf(F.col("density"), F.lit(20.0), F.lit(2.0)), 6).alias("lognormal"), F.round(D.uniform_cdf(x, F.lit(5.0), F.lit(35.0)), 6).alias("uniform_cdf"))


@study("select sample_id, taxon, round(lgamma(raw + 10) - lgamma(10) - lgamma(raw + 1) + 10 * ln(10 / (10 + m)) + raw * ln(m / (10 + m)), 5) ll, round(m + 0.1 * m * m, 4) as variance from (select *, greatest(rel * depth, 1) m from ab where rel is not null)")
def c16_c17_negbin(s):
    """Log-likelihood of every count under a negative binomial of its expected depth share, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def ll(k, m):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series(D.negbin_logpmf(k.to_numpy(float), m.to_numpy(float), 0.1))

    rows = s.abundance.where("rel is not null").withColumn("m", F.greatest(F.col("rel") * F.col("depth"), F.lit(1.0)))
    return rows.select("sample_id", "taxon", F.round(ll(F.col("raw").cast("double"), "m"), 5).alias("ll"), F.round(D.negbin_variance(F.col("m"), F.lit(0.1)), 4).alias("variance"))


@study("select taxon_idx, time, round(value, 6) x from (select taxon_idx, time, sum(rel) / max(present) as value from ab join (select time, count(*) present from samples group by 1) using (time) group by 1, 2)")
def l7_extract_abundances(s):
    """Mean abundances over subjects at every time."""
    return R.aggregate_over_subjects(s, "rel", "mean").select("taxon_idx", "time", F.round("value", 6).alias("x"))
