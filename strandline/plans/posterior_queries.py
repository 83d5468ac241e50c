"""Queries over trace tables, with their SQL.

The traces are read from the tables at hand: each embedding is a draw of an 8 x 8 system (chain = vec_id modulo 4,
gibbs = vec_id div 4; component 8 * tgt + src), each event a scalar draw.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import labels
from strandline.operators import posterior as P
from strandline.operators import sequences as Q
from strandline.session import read_table

OFF = 0.05  #: components below this are indicators that are off
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BASE = f"""
with v as (select vec_id % 4 chain, vec_id // 4 gibbs, embedding, label, vec_id from embeddings),
e as materialized (select chain, gibbs, (k - 1) // 8 tgt, (k - 1) % 8 src, cast(embedding[k] as double) x from v, unnest(range(1, 65)) u(k)),
edge as materialized (select chain, gibbs, tgt, src, case when abs(x) >= {OFF} then x end as value from e where tgt <> src),
growth as materialized (select chain, gibbs, tgt idx, abs(x) + 0.1 as value from e where tgt = src),
assign as materialized (select chain, gibbs, tgt item, max(src) filter (src < 4 and x = mx) cid from (select *, max(case when src < 4 then x end) over (partition by chain, gibbs, tgt) mx from e) group by 1, 2, 3),
scalar as (select user_id % 4 chain, event_type as var, row_number() over (partition by user_id % 4, event_type order by event_id) - 1 gibbs, value from events)
"""


class Traces:
    """The trace tables of a directory."""

    def __init__(self, spark: SparkSession, d: str):
        v = read_table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("chain"), F.floor(F.col("vec_id") / 4).alias("gibbs"), F.posexplode("embedding").alias("k", "x"))
        self.cells = v.select("chain", "gibbs", F.floor(F.col("k") / 8).cast("int").alias("tgt"), (F.col("k") % 8).alias("src"), F.col("x").cast("double").alias("x"))
        self.edge = self.cells.where("tgt <> src").select("chain", "gibbs", "tgt", "src", F.when(F.abs("x") >= OFF, F.col("x")).alias("value"))
        self.growth = self.cells.where("tgt = src").select("chain", "gibbs", F.col("tgt").alias("idx"), (F.abs("x") + 0.1).alias("value"))
        self.assign = self.cells.where("src < 4").groupBy("chain", "gibbs", F.col("tgt").alias("item")).agg(F.max(F.struct("x", "src"))["src"].alias("cid"))
        ev = read_table(spark, d, "events")
        w = Window.partitionBy("chain", "var").orderBy("event_id")
        self.scalar = ev.select((F.col("user_id") % 4).alias("chain"), F.col("event_type").alias("var"), "event_id", "value").withColumn("gibbs", F.row_number().over(w) - 1).drop("event_id")
        self.n_draws = self.growth.where("idx = 0").groupBy("chain").agg((F.max("gibbs") + 1).alias("n"))


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(Traces(spark, d))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = BASE + sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_Q = "round({0}, 6) {1}"


def _sum(by: str, src: str, x: str = "value") -> str:
    return f"select {by}, round(coalesce(avg({x}), 0), 6) mean, round(coalesce(quantile_cont({x}, 0.25), 0), 6) p25, round(coalesce(median({x}), 0), 6) median, round(coalesce(quantile_cont({x}, 0.75), 0), 6) p75 from {src} group by {by}"


@query("select chain, count(*) n, round(avg(value), 6) mean from growth where gibbs >= 20 and idx = 3 group by 1")
def s21_trace_section(t):
    return P.section(t.growth, 20).where("idx = 3").groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("select chain, max(gibbs) + 1 n from growth where idx = 0 group by 1")
def s22_trace_length(t):
    return t.n_draws


@query("select chain, var, count(*) kept from scalar where gibbs < 50 group by 1, 2")
def w14_resume(t):
    """What a run resumed from draw 50 keeps."""
    return P.section(t.scalar, 50, "burnin").groupBy("chain", "var").agg(F.count(F.lit(1)).alias("kept"))


@query("select chain, var, min(gibbs - 20) first_iter, max(gibbs - 20) last_iter from scalar group by 1, 2")
def w13_trace_index(t):
    it = F.col("gibbs") - 20
    return t.scalar.groupBy("chain", "var").agg(F.min(it).alias("first_iter"), F.max(it).alias("last_iter"))


@query(_sum("idx", "growth"))
def a16_summary_growth(t):
    return rounded(P.summary(t.growth, ["idx"]), "mean", "p25", "median", "p75")


@query(_sum("tgt, src", "edge"))
def a16_summary_edges(t):
    return rounded(P.summary(t.edge, ["tgt", "src"]), "mean", "p25", "median", "p75")


@query(_sum("tgt, src", "edge", "coalesce(value, 0)"))
def r4_edge_matrices(t):
    return rounded(P.summary(t.edge, ["tgt", "src"], nan_to_zero=True), "mean", "p25", "median", "p75")


@query(_sum("var", "scalar"))
def r1_scalar_report(t):
    return rounded(P.summary(t.scalar, ["var"]), "mean", "p25", "median", "p75")


@query("select idx, round(quantile_cont(value, 0.025), 6) q0_025, round(quantile_cont(value, 0.975), 6) q0_975 from growth group by 1")
def a17_intervals(t):
    return rounded(P.quantiles(t.growth, ["idx"], [0.025, 0.975]), "q0_025", "q0_975")


_BF = "select tgt, src, count(value) n_on, count(*) - count(value) n_off, case when count(*) = count(value) then 'inf'::double else round(count(value) * 4.0 / ((count(*) - count(value)) * 1.0), 6) end bf from edge group by 1, 2"


@query(_BF)
def a18_bayes_factors(t):
    return rounded(P.bayes_factors(t.edge, ["tgt", "src"], 1.0, 4.0), "bf")


@query("select chain, src item, count(value) n_on, count(*) - count(value) n_off, round(count(value) * 2.0 / nullif(count(*) - count(value), 0), 6) bf from edge where tgt = 0 group by 1, 2")
def a19_perturbation_bayes_factors(t):
    rows = t.edge.where("tgt = 0").select("chain", "gibbs", F.col("src").alias("item"), "value")
    got = P.bayes_factors(rows, ["chain", "item"], 1.0, 2.0)
    return rounded(got.withColumn("bf", F.when(F.col("n_off") > 0, F.col("bf"))), "bf")


@query("select chain, gibbs, item, sum(i) n_in, sum(o) n_out from (select chain, gibbs, tgt item, 1 i, 0 o from edge where value is not null union all select chain, gibbs, src, 0, 1 from edge where value is not null) group by 1, 2, 3")
def a20_degrees(t):
    return P.degrees(t.edge)


@query("select chain, gibbs, count(value) n_pos, count(*) - count(value) n_neg from edge group by 1, 2")
def a21_indicator_counts(t):
    return t.edge.groupBy("chain", "gibbs").agg(F.count("value").alias("n_pos"), (F.count(F.lit(1)) - F.count("value")).alias("n_neg"))


@query("select a.item a, b.item b, round(count(*) * 1.0 / (select count(*) from v), 6) p from assign a join assign b using (chain, gibbs, cid) where a.item < b.item group by 1, 2")
def a22_coclusters(t):
    return rounded(P.coclusters(t.assign), "p")


@query("select n_clusters, count(*) n_draws from (select count(distinct cid) n_clusters from assign group by chain, gibbs) group by 1 order by n_draws desc, n_clusters limit 1")
def a23_cluster_mode(t):
    return P.cluster_count_mode(t.assign)


@query("select tgt, src, cast(sum(sign(coalesce(value, 0))) as bigint) as sign from edge group by 1, 2")
def a24_sign_majority(t):
    return P.sign_majority(t.edge)


@query("select round(max(bf), 6) largest from (" + _BF.replace("'inf'::double", "null") + ")")
def a25_largest_weight(t):
    return P.bayes_factors(t.edge, ["tgt", "src"], 1.0, 4.0).where("bf < double('Infinity')").agg(F.round(F.max("bf"), 6).alias("largest"))


@query("select chain, cid, count(*) size, array_to_string(list_sort(list(distinct cast(item as varchar))), ',') members from assign group by 1, 2")
def a26_members(t):
    return t.assign.groupBy("chain", "cid").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_set(F.col("item").cast("string"))), ",").alias("members"))


_MOM = "m as (select chain, idx, count(*) n, avg(value) m, var_samp(value) s2 from growth group by 1, 2), g as (select idx, min(n)::double n, count(*)::double k, avg(s2) w, var_samp(m) vm, avg(m) xb, var_pop(s2) vs, covar_samp(s2, m * m) c2, covar_samp(s2, m) c1 from m group by 1), b as (select *, n * vm b from g), vv as (select *, (n-1)/n*w + b/n + b/(n*k) v, pow((n-1)/n, 2)/k*vs + pow((k+1)/(k*n), 2)*(2/(k-1))*b*b + 2*(k+1)*(n-1)/(k*k*n)*(c2 - 2*xb*c1) var_v from b)"


@query(", " + _MOM + " select idx, round(w, 6) w, round(b, 6) b, round(sqrt(v * (2*v*v/var_v + 3) / (w * (2*v*v/var_v + 1))), 6) rhat from vv")
def a27_r_hat(t):
    return rounded(P.r_hat(t.growth, ["idx"]), "w", "b", "rhat")


@query(", l as (select chain, max(gibbs) + 1 n from growth group by 1), h as (select chain * 2 + case when gibbs >= n // 2 then 1 else 0 end c, idx, value from growth join l using (chain) where gibbs < 2 * (n // 2)), m as (select c, idx, count(*) n, avg(value) m, var_samp(value) s2 from h group by 1, 2) select idx, round(sqrt(((1 - 1.0 / min(n)) * avg(s2) + var_samp(m)) / avg(s2)), 6) rhat from m group by 1")
def a28_split_r_hat(t):
    return rounded(P.split_r_hat(t.growth, ["idx"], t.n_draws), "rhat")


@query(", p as (select a.chain, a.gibbs, a.idx, a.value x, b.value y from growth a join growth b on a.gibbs = b.gibbs and a.idx = b.idx and a.chain = 0 and b.chain = 1) select idx, round(sqrt(avg((x-y)*(x-y))), 6) rmse, round(sqrt(avg(pow((x-y)/y, 2))), 6) rel_rmse, round(avg(abs((x-y)/y)), 6) pe, round(avg(abs(ln(x)-ln(y))), 6) log_pe from p group by 1")
def a29_errors(t):
    a = t.growth.where("chain = 0").select("gibbs", "idx", F.col("value").alias("x"))
    b = t.growth.where("chain = 1").select("gibbs", "idx", F.col("value").alias("y"))
    return rounded(P.errors(a.join(b, ["gibbs", "idx"]), "x", "y", ["idx"]), "rmse", "rel_rmse", "pe", "log_pe")


@query(""", s as (select chain, tgt, src, count(value) * 1.0 / count(*) p, case when avg(x) > 0 then 1 else 0 end y from edge join e using (chain, gibbs, tgt, src) group by 1, 2, 3),
  r as (select *, rank() over (partition by chain order by p) + (count(*) over (partition by chain, p) - 1) / 2.0 r from s) select chain, round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) auc from r group by 1""")
def a30_roc_auc(t):
    rows = t.edge.join(t.cells, ["chain", "gibbs", "tgt", "src"]).groupBy("chain", "tgt", "src").agg((F.count("value") / F.count(F.lit(1))).alias("p"), (F.avg("x") > 0).cast("int").alias("y"))
    return rounded(P.roc_auc(rows, "p", "y", ["chain"]), "auc")


@query(", c as (select cid, chain, count(*) c from assign group by 1, 2), w as (select c, sum(c) over (partition by cid) px, sum(c) over (partition by chain) py, sum(c) over () n from c) select round(abs(sum(c / n * (ln(c / px) + ln(c / py)))), 6) vi from w")
def a31_variation_of_information(t):
    return rounded(P.variation_of_information(t.assign, "cid", "chain"), "vi")


@query(", ch as (select chain, var, gibbs, case when value <> lag(value) over (partition by chain, var order by gibbs) then 1 else 0 end c from scalar) select chain, var, round((1.0 + sum(c)) / count(*), 6) rate from ch group by 1, 2")
def a34_acceptance(t):
    ch = F.coalesce((F.col("value") != F.lag("value").over(Window.partitionBy("chain", "var").orderBy("gibbs"))).cast("int"), F.lit(0))
    return t.scalar.withColumn("c", ch).groupBy("chain", "var").agg(F.round((1 + F.sum("c")) / F.count(F.lit(1)), 6).alias("rate"))


@query(""", ch as (select chain, var, gibbs, case when floor(value / 50) <> lag(floor(value / 50)) over (partition by chain, var order by gibbs) then 1 else 0 end c from scalar)
  select chain, var, gibbs, round(case when gibbs = 0 then 0 else coalesce(sum(c) over (partition by chain, var order by gibbs rows between 49 preceding and 1 preceding), 0) * 1.0 / least(gibbs, 50) end, 6) rate from ch""")
def w5_rolling_acceptance(t):
    rows = t.scalar.withColumn("cell", F.floor(F.col("value") / 50))
    return Q.rolling_acceptance(rows, ["chain", "var"], "gibbs", "cell", 50).select("chain", "var", "gibbs", F.round("rate", 6).alias("rate"))


@query(", rep as (select chain, gibbs, cid, min(item) rep from assign group by 1, 2, 3) select e.chain, e.gibbs, t.cid tgt_cid, s.cid src_cid, round(e.value, 6) as value from edge e join rep t on t.chain = e.chain and t.gibbs = e.gibbs and t.rep = e.tgt join rep s on s.chain = e.chain and s.gibbs = e.gibbs and s.rep = e.src where t.cid <> s.cid")
def a38_condense(t):
    rep = t.assign.groupBy("chain", "gibbs", "cid").agg(F.min("item").alias("rep"))
    a, b = rep.select("chain", "gibbs", F.col("rep").alias("tgt"), F.col("cid").alias("tgt_cid")), rep.select("chain", "gibbs", F.col("rep").alias("src"), F.col("cid").alias("src_cid"))
    return t.edge.join(a, ["chain", "gibbs", "tgt"]).join(b, ["chain", "gibbs", "src"]).where("tgt_cid <> src_cid").select("chain", "gibbs", "tgt_cid", "src_cid", F.round("value", 6).alias("value"))


@query("select chain, gibbs, tgt, " + ", ".join(f"round(max(case when src = {i} then value end), 6) s{i}" for i in range(8)) + " from edge group by 1, 2, 3")
def a39_value_matrix(t):
    return t.edge.groupBy("chain", "gibbs", "tgt").agg(*[F.round(F.max(F.when(F.col("src") == i, F.col("value"))), 6).alias(f"s{i}") for i in range(8)])


@query("select idx, round(sum(value / (value * value + 0.1)) / sum(1 / (value * value + 0.1)), 6) mean, round(ln(1 / sum(1 / (value * value + 0.1))), 6) log_var from growth group by 1")
def a40_product_of_gaussians(t):
    got = P.product_of_gaussians(t.growth.withColumn("var", F.col("value") * F.col("value") + 0.1), ["idx"], "value", "var")
    return got.select("idx", F.round("mean", 6).alias("mean"), F.round(F.ln("var"), 6).alias("log_var"))


@query("select chain, gibbs, tgt, src, round(value, 6) as value from edge where value is not null")
def f17_valid_edges(t):
    return t.edge.where("value is not null").withColumn("value", F.round("value", 6))


@query("select chain, gibbs, 'in' as direction, src other from edge where tgt = 2 and value is not null union all select chain, gibbs, 'out', tgt from edge where src = 2 and value is not null")
def f18_adjacent(t):
    on = t.edge.where("value is not null")
    return on.where("tgt = 2").select("chain", "gibbs", F.lit("in").alias("direction"), F.col("src").alias("other")).unionByName(on.where("src = 2").select("chain", "gibbs", F.lit("out").alias("direction"), F.col("tgt").alias("other")))


@query("select chain, gibbs, tgt, src from (select *, row_number() over (partition by chain, gibbs order by tgt, src) - 1 k from edge) where k = 10")
def f19_edge_iloc(t):
    """The tenth edge in row-major order with the diagonal skipped: found by arithmetic on dense indexes."""
    n = 8
    k = F.col("tgt") * (n - 1) + F.col("src") - (F.col("src") > F.col("tgt")).cast("int")
    return t.edge.where(k == 10).select("chain", "gibbs", "tgt", "src")


@query("select tgt, src, bf from (" + _BF + ") where bf >= 5")
def f20_bayes_threshold(t):
    return rounded(P.bayes_factors(t.edge, ["tgt", "src"], 1.0, 4.0), "bf").where("bf >= 5").select("tgt", "src", "bf")


@query("select chain, gibbs from edge group by 1, 2 having count(*) = count(value) or count(value) > 30")
def f16_complete_draws(t):
    return t.edge.groupBy("chain", "gibbs").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("m")).where("n = m or n > 30").select("chain", "gibbs")


@query("select tgt, src, bf, case when bf > 100 then 3 when bf > 10 then 2 when bf > 0 then 1 else 0 end category from (" + _BF + ")")
def c11_evidence(t):
    got = rounded(P.bayes_factors(t.edge, ["tgt", "src"], 1.0, 4.0), "bf")
    return got.select("tgt", "src", "bf", labels.evidence_category("bf").alias("category"))


@query("select tgt, src, round(log10(abs(mean)), 6) log_size, case when mean > 0 then '+' else '-' end sign from (select tgt, src, avg(value) mean from edge group by 1, 2) where mean <> 0")
def c12_signed_log(t):
    m = t.edge.groupBy("tgt", "src").agg(F.avg("value").alias("mean")).where("mean <> 0")
    return m.select("tgt", "src", F.round(F.log10(F.abs("mean")), 6).alias("log_size"), F.when(F.col("mean") > 0, "+").otherwise("-").alias("sign"))


@query("select tgt, src, least(bf, 3.5) bf from (" + _BF + ")")
def c13_capped_bayes(t):
    return rounded(P.bayes_factors(t.edge, ["tgt", "src"], 1.0, 4.0), "bf").select("tgt", "src", F.least("bf", F.lit(3.5)).alias("bf"))


@query("select chain, gibbs, item, dense_rank() over (partition by chain, gibbs order by low) - 1 as label from (select *, min(item) over (partition by chain, gibbs, cid) low from assign)")
def g4_canonical_labels(t):
    return P.canonical_labels(t.assign, ["chain", "gibbs"]).select("chain", "gibbs", "item", "label")


@query(", c as (select chain, gibbs, cid, count(*) size, min(item) low from assign group by 1, 2, 3) select chain, gibbs, cid, size, row_number() over (partition by chain, gibbs order by size desc, low) - 1 place from c")
def k4_cluster_order(t):
    c = t.assign.groupBy("chain", "gibbs", "cid").agg(F.count(F.lit(1)).alias("size"), F.min("item").alias("low"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("chain", "gibbs").orderBy(F.desc("size"), "low")) - 1).drop("low")


@query("select chain, gibbs, item, row_number() over (partition by chain, gibbs order by low, item) - 1 place from (select *, min(item) over (partition by chain, gibbs, cid) low from assign)")
def k5_item_order(t):
    low = F.min("item").over(Window.partitionBy("chain", "gibbs", "cid"))
    return t.assign.withColumn("low", low).withColumn("place", F.row_number().over(Window.partitionBy("chain", "gibbs").orderBy("low", "item")) - 1).select("chain", "gibbs", "item", "place")


@query("select chain, gibbs, idx, round(value, 6) as value from growth where gibbs % 10 = 0")
def k8_thin(t):
    return t.growth.where("gibbs % 10 = 0").withColumn("value", F.round("value", 6))


@query("select e.chain, e.gibbs, e.tgt, e.src, round(g.value * e.value, 6) stability from edge e join growth g on g.chain = e.chain and g.gibbs = e.gibbs and g.idx = e.tgt where e.value is not null")
def d7_stability(t):
    g = t.growth.select("chain", "gibbs", F.col("idx").alias("tgt"), F.col("value").alias("r"))
    return t.edge.where("value is not null").join(g, ["chain", "gibbs", "tgt"]).select("chain", "gibbs", "tgt", "src", F.round(F.col("r") * F.col("value"), 6).alias("stability"))


@query("select chain, var, gibbs, round(value * case var when 'click' then 2.5 when 'view' then 6.25 when 'purchase' then 0.4 else 1 end, 6) as value from scalar")
def d8_denormalise(t):
    return rounded(P.denormalise(t.scalar, {"click": 1, "view": 2, "purchase": -1}, 2.5), "value").select("chain", "var", "gibbs", "value")


_SIM = ", sim as (select case when chain = 0 then null else chain - 1 end scenario, gibbs, idx taxon, value * 1e6 x from growth), mem as (select distinct idx taxon, idx % 3 cid from growth)"


@query(_SIM + ", a as (select a.scenario as cluster, a.gibbs, avg(log10(b.x + 1e5) - log10(a.x + 1e5)) d from sim a join sim b on b.scenario is null and a.scenario is not null and a.gibbs = b.gibbs and a.taxon = b.taxon where not exists (select 1 from mem where mem.taxon = a.taxon and mem.cid = a.scenario) group by 1, 2) select cluster, round(avg(d), 6) ky from a group by 1")
def d9_keystoneness(t):
    sim, mem = _simulated(t)
    return rounded(P.keystoneness(sim, mem), "ky")


@query(_SIM + ", s as (select scenario, cid, gibbs, sum(x) x from sim join mem using (taxon) group by 1, 2, 3) select scenario, cid, round(log10(median(x)), 6) log_median from s group by 1, 2")
def a13_abundance_array(t):
    sim, mem = _simulated(t)
    return P.cluster_abundance_medians(sim, mem).select("scenario", "cid", F.round(F.log10("median"), 6).alias("log_median"))


@query(_SIM + ", d as (select a.scenario as cluster, a.taxon, log10(avg(b.x) + 1e5) - log10(avg(a.x) + 1e5) d from sim a join sim b on b.scenario is null and a.scenario is not null and a.gibbs = b.gibbs and a.taxon = b.taxon group by 1, 2), m as (select d.*, mem.cid from d join mem using (taxon)) select cluster, taxon, round(case when cid = cluster then null else d end, 6) diff from m")
def d10_difference_matrix(t):
    sim, mem = _simulated(t)
    means = sim.groupBy("scenario", "taxon").agg(F.avg("x").alias("x"))
    base = means.where("scenario is null").select("taxon", F.log10(F.col("x") + 1e5).alias("b"))
    alt = means.where("scenario is not null").join(base, "taxon").join(mem, "taxon")
    return alt.select(F.col("scenario").alias("cluster"), "taxon", F.round(F.when(F.col("cid") != F.col("scenario"), F.col("b") - F.log10(F.col("x") + 1e5)), 6).alias("diff"))


def _simulated(t) -> tuple[DataFrame, DataFrame]:
    sim = t.growth.select(F.when(F.col("chain") > 0, F.col("chain") - 1).alias("scenario"), "gibbs", F.col("idx").alias("taxon"), (F.col("value") * 1e6).alias("x"))
    return sim, t.growth.select(F.col("idx").alias("taxon"), (F.col("idx") % 3).alias("cid")).distinct()


@query(_SIM + ", s as (select gibbs, taxon, x from sim where scenario is null) select taxon, round(quantile_cont(x, 0.25), 3) q0_25, round(quantile_cont(x, 0.5), 3) q0_5, round(quantile_cont(x, 0.75), 3) q0_75 from s group by 1")
def d6_trajectory_quantiles(t):
    got = P.quantiles(_simulated(t)[0].where("scenario is null"), ["taxon"], [0.25, 0.5, 0.75], "x")
    return got.withColumns({c: F.round(c, 3) for c in ("q0_25", "q0_5", "q0_75")})


@query(", bf as (" + _BF + "), w as (select tgt, src, avg(coalesce(value, 0)) weight, cast(sum(sign(coalesce(value, 0))) as bigint) sg from edge group by 1, 2), x as (select bf.tgt, bf.src, weight, sg, bf from bf join w using (tgt, src) where bf > 0 and weight <> 0) select tgt, src, round(weight, 6) weight, sg as sign, exists (select 1 from x y where y.tgt = x.src and y.src = x.tgt) bend from x")
def g9_network_edges(t):
    e = _network(t).where("bf > 0 and weight <> 0")
    back = e.select(F.col("src").alias("tgt"), F.col("tgt").alias("src"), F.lit(True).alias("bend"))
    return e.join(back, ["tgt", "src"], "left").select("tgt", "src", F.round("weight", 6).alias("weight"), "sign", F.coalesce("bend", F.lit(False)).alias("bend"))


def _network(t) -> DataFrame:
    weight = t.edge.groupBy("tgt", "src").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("weight"))
    return P.bayes_factors(t.edge, ["tgt", "src"], 1.0, 4.0).join(weight, ["tgt", "src"]).join(P.sign_majority(t.edge), ["tgt", "src"])


@query()
def s29_network_json(t):
    nodes = t.growth.groupBy(F.col("idx").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    return P.network_json(_network(t), nodes)


@query("select chain, gibbs, tgt, src, x.value is not null as on_both from edge x")
def j13_expand(t):
    """Cluster-level indicators at item level; here every item is its own cluster."""
    mem = t.growth.select(F.col("idx").alias("item"), F.col("idx").alias("cid")).distinct()
    c = t.edge.select("chain", "gibbs", F.col("tgt").alias("tgt_cid"), F.col("src").alias("src_cid"), "value")
    return P.expand_edges(c, mem).select("chain", "gibbs", "tgt", "src", F.col("value").isNotNull().alias("on_both"))


@query("select e.chain, e.gibbs, a.item, round(e.value, 6) as value from assign a join growth e on e.chain = a.chain and e.gibbs = a.gibbs and e.idx = a.cid")
def j14_item_values(t):
    c = t.growth.select("chain", "gibbs", F.col("idx").alias("cid"), "value")
    return t.assign.join(c, ["chain", "gibbs", "cid"]).select("chain", "gibbs", "item", F.round("value", 6).alias("value"))


@query("select var, cast(floor(ln(value) / 0.25) as int) bin, count(*) n from scalar where value > 0 group by 1, 2")
def r8_log_histogram(t):
    return t.scalar.where("value > 0").groupBy("var", F.floor(F.ln("value") / 0.25).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("select chain, var, n from (select chain, var, count(*) n, round(avg(value), 6) a from scalar group by 1, 2)")
def t7_chains(t):
    """Chains brought together again after a run of each."""
    parts = [t.scalar.where(F.col("chain") == c) for c in range(4)]
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    return one.groupBy("chain", "var").agg(F.count(F.lit(1)).alias("n"))
