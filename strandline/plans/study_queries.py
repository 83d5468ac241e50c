"""Queries over the study model, with their SQL: sources, filters, joins, aggregates, windows, sets, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import labels
from strandline.operators import relational as R
from strandline.operators import sequences as Q
from strandline.operators.study import LEVELS, Study
from strandline.sources.tables import wide_qpcr

KEY = "nullif(upper(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '')"
_LV = ", ".join(f"coalesce(nullif(trim(\"{c}\"), ''), 'NA') \"{c}\"" for c in LEVELS)
BASE = f"""
with taxa as (select idx, name, upper(regexp_replace(sequence, '[\\s-]', '', 'g')) as "sequence", {_LV} from taxonomy),
m1 as (select {KEY.format('sampleid')} sample_id, {KEY.format('subject')} subject, time, withdrawn_at, row_number() over (partition by {KEY.format('sampleid')} order by loaded_at desc) rn from metadata),
m2 as (select subject, time, max(sample_id) sample_id from m1 where rn = 1 and sample_id is not null and withdrawn_at is null and subject is not null and time is not null and not isnan(time) group by 1, 2),
samples as (select sample_id, subject, time, cast(row_number() over (partition by subject order by time) - 1 as int) tidx from m2),
c1 as (select name taxon, {KEY.format('sampleid')} sample_id, "count" n, row_number() over (partition by name, {KEY.format('sampleid')} order by loaded_at desc, "count" desc nulls last) rn from counts),
reads as (select sample_id, taxon, n as count from c1 where rn = 1 and n is not null and sample_id is not null and taxon is not null),
q1 as (select *, {KEY.format('sampleid')} sk, row_number() over (partition by reading_id order by loaded_at desc) rn from qpcr),
qpcr_c as (select reading_id, sk sample_id, rep, cfu * dilution / mass density from q1 where rn = 1 and sk is not null and cfu > 0 and isfinite(cfu) and mass > 0),
perts as (select distinct lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) as name, pidx, {KEY.format('subject')} subject, start, "end" from perturbations
  where not isnan(start) and not isnan("end") and "end" > start and {KEY.format('subject')} is not null),
bio as (select sample_id, count(*) n, avg(ln(density)) loc, stddev_pop(ln(density)) as scale, exp(avg(ln(density))) gmean from qpcr_c group by 1),
cells as (select r.sample_id, subject, time, tidx, t.idx taxon_idx, taxon, r.count raw from reads r join samples s using (sample_id) join taxa t on t.name = r.taxon),
ab0 as (select *, sum(raw) over (partition by sample_id) depth from cells),
ab as (select ab0.*, raw / nullif(depth, 0) rel, gmean biomass, raw / nullif(depth, 0) * gmean as abs from ab0 left join bio using (sample_id))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Registers a query (spark, directory) and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (BASE if base else "") + sql
        return f

    return add


def study_query(sql: str | None = None):
    """Registers a query over the study model."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(Study.load(spark, d))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        return query(sql)(run)

    return add


def lg(c: str) -> F.Column:
    """log10, rounded: large magnitudes that compare exactly."""
    return F.round(F.log10(F.when(F.col(c) > 0, F.col(c))), 6)


# ---------------------------------------------------------------- sources


@study_query("select idx, name, \"sequence\", " + ", ".join(f'"{c}"' for c in LEVELS) + " from taxa")
def s9_taxa(s):
    return s.taxa.select("idx", "name", "sequence", *LEVELS)


@study_query("select sample_id, subject, time from samples")
def s7_samples(s):
    return s.samples.select("sample_id", "subject", "time")


@study_query("select sample_id, subject, time, taxon, raw, depth, round(rel, 6) rel, round(log10(case when abs > 0 then abs end), 6) log_abs from ab")
def s8_ingest(s):
    a = s.abundance
    return a.select("sample_id", "subject", "time", "taxon", "raw", "depth", F.round("rel", 6).alias("rel"), lg("abs").alias("log_abs"))


@study_query("select taxon as name, count(*) n_samples, cast(sum(raw) as bigint) total, cast(max(raw) as bigint) largest from cells where taxon_idx < 15 group by 1")
def s35_toy(s):
    """The toy extract: the first taxa only, cut before the reads are joined."""
    toy = s.replace(taxa=s.taxa.where("idx < 15"))
    return toy.cells.groupBy(F.col("taxon").alias("name")).agg(F.count(F.lit(1)).alias("n_samples"), F.sum("raw").alias("total"), F.max("raw").alias("largest"))


@study_query("select name, min(pidx) pidx, count(distinct subject) n_subjects, round(min(start), 6) first_start, round(max(\"end\"), 6) last_end from perts group by name")
def s4_perturbations(s):
    return s.perts.groupBy("name").agg(F.min("pidx").alias("pidx"), F.count_distinct("subject").alias("n_subjects"), F.round(F.min("start"), 6).alias("first_start"), F.round(F.max("end"), 6).alias("last_end"))


@study_query("""pivot (select sample_id, round(log10(density), 6) d, 'measurement' || row_number() over (partition by sample_id order by rep, reading_id) k from qpcr_c)
  on k using max(d) group by sample_id""")
def s12_wide_qpcr(s):
    """The wide replicate table, padded with NULL to the most replicates of any sample."""
    wide = wide_qpcr(s)
    return wide.select(F.col("sampleID").alias("sample_id"), *[lg(c).alias(c) for c in wide.columns if c != "sampleID"])


@study_query("""select taxon as name, cast(sum(case when subject[1] = 'T' then raw end) as bigint) "T", cast(sum(case when subject[1] = 'U' then raw end) as bigint) "U",
  cast(sum(case when subject[1] = 'R' then raw end) as bigint) "R", cast(sum(case when subject[1] = 'H' then raw end) as bigint) "H", cast(sum(case when subject[1] = 'K' then raw end) as bigint) "K" from cells group by 1""")
def s11_wide_counts(s):
    """The wide table, one column per cohort letter (one per sample would be as wide as the study is long)."""
    return s.cells.withColumn("cohort", F.substring("subject", 1, 1)).groupBy(F.col("taxon").alias("name")).pivot("cohort", ["T", "U", "R", "H", "K"]).agg(F.sum("raw"))


@study_query("select taxon as name, count(*) n_samples, string_agg(sample_id || '=' || raw, ';' order by sample_id || '=' || raw) cells from cells group by 1")
def s11_sample_counts(s):
    """A row per taxon with its count in every sample that has one, as one column whatever the number of samples."""
    cell = F.concat(F.col("sample_id"), F.lit("="), F.col("raw").cast("string"))
    rows = s.cells.groupBy(F.col("taxon").alias("name")).agg(F.count(F.lit(1)).alias("n_samples"), F.array_sort(F.collect_list(cell)).alias("c"))
    return rows.select("name", "n_samples", F.array_join("c", ";").alias("cells"))


# ---------------------------------------------------------------- filters


@study_query("select cast(row_number() over (order by idx) - 1 as int) idx, name from taxa where phylum <> 'NA' and genus <> 'NA'")
def f1_drop_taxa(s):
    """Taxa without phylum or genus are dropped, the rest numbered anew."""
    return s.pop_taxa(s.taxa.where("phylum = 'NA' or genus = 'NA'")).taxa.select("idx", "name")


@study_query("select name from taxa where name in (select taxon from cells where subject like 'U%')")
def f2_taxa_like(s):
    """Taxa that the U cohort's study holds as well."""
    other = s.split_subjects(F.col("subject").startswith("U"))[0]
    return s.keep_taxa(other.cells.select(F.col("taxon").alias("name"))).taxa.select("name")


@study_query("select sample_id, subject, time from samples where split_part(sample_id, '-', 1) in ('T0000005', 'U0000033', 'H0000006')")
def f3_cohort(s):
    return s.samples.where(R.cohort("sample_id", ["T0000005", "U0000033", "H0000006"])).select("sample_id", "subject", "time")


@study_query("select sample_id, subject from samples where contains(sample_id, '-01')")
def f4_contains(s):
    return s.samples.where(F.col("sample_id").contains("-01")).select("sample_id", "subject")


@study_query("select case when subject like 'T%' or subject like 'U%' then 'first' else 'second' end half, count(*) n_samples, count(distinct subject) n_subjects from samples group by 1")
def f6_split_study(s):
    a, b = s.split_subjects(F.col("subject").startswith("T") | F.col("subject").startswith("U"))
    one = [x.samples.agg(F.lit(n).alias("half"), F.count(F.lit(1)).alias("n_samples"), F.count_distinct("subject").alias("n_subjects")) for n, x in (("first", a), ("second", b))]
    return one[0].unionByName(one[1])


@study_query("select sample_id, time, cast(row_number() over (partition by subject order by time) - 1 as int) tidx from samples where time >= 5")
def f7_pop_times(s):
    return s.pop_times(s.samples.where("time < 5").select("subject", "time")).samples.select("sample_id", "time", "tidx")


@study_query("select distinct s.sample_id, p.name pert from samples s join perts p on s.subject = p.subject and s.time > p.start and s.time <= p.\"end\"")
def f8_active(s):
    return R.interval_join(s.samples, s.perts).where("pert is not null").select("sample_id", "pert").distinct()


@study_query("""select subject, time, subject || '_' || k segment from (select subject, time, sum(new) over (partition by subject order by tidx) k from (
  select subject, time, tidx, case when tidx - lag(tidx) over (partition by subject order by tidx) > 1 then 1 else 0 end new from samples s
  where not exists (select 1 from perts p where p.subject = s.subject and s.time > p.start and s.time <= p."end")))""")
def f9_split_on_perturbations(s):
    return Q.segments_outside(s.samples, s.perts)


@study_query("select sample_id, round(time, 6) as time from samples where time >= 10")
def f10_colonization(s):
    return s.samples.where("time >= 10").select("sample_id", F.round("time", 6).alias("time"))


@study_query("select sample_id, taxon, round(log10(greatest(least(abs, 1e10), 1e5)), 6) x from ab where abs is not null")
def f11_f12_bounds(s):
    """Limit of detection below, simulation ceiling above."""
    x = F.greatest(F.least("abs", F.lit(1e10)), F.lit(1e5))
    return s.abundance.where("abs is not null").select("sample_id", "taxon", F.round(F.log10(x), 6).alias("x"))


@study_query("select " + ", ".join(f"count(*) filter (\"{c}\" <> 'NA') \"{c}\"" for c in LEVELS) + " from taxa")
def f13_defined(s):
    return s.taxa.agg(*[F.count_if(F.col(c) != "NA").alias(c) for c in LEVELS])


@study_query("select sample_id from samples s where not exists (select 1 from perts p where p.subject = s.subject and s.time > p.start and s.time <= p.\"end\")")
def f14_outside(s):
    return R.outside_perturbations(s.samples, s.perts).select("sample_id")


@study_query("""select subject, taxon_idx, tidx from (select *, lead(tidx) over w nt, lead(raw) over w nr from cells where raw is not null window w as (partition by subject, taxon_idx order by tidx)) where raw > 0 and nt = tidx + 1 and nr > 0""")
def f15_present_rows(s):
    """Regression rows whose taxon is there at both ends."""
    w = Window.partitionBy("subject", "taxon_idx").orderBy("tidx")
    rows = s.cells.withColumn("nxt", F.lead(F.struct("tidx", "raw")).over(w))
    return rows.where("raw > 0 and nxt.tidx = tidx + 1 and nxt.raw > 0").select("subject", "taxon_idx", "tidx")


# ---------------------------------------------------------------- joins


@study_query("select distinct sample_id from reads where sample_id not in (select sample_id from samples)")
def j1_unknown_samples(s):
    return R.unknown_references(s.reads, s.samples, "sample_id")


@study_query("select distinct sample_id from qpcr_c where sample_id not in (select sample_id from samples)")
def j2_unknown_qpcr(s):
    return R.unknown_references(s.qpcr, s.samples, "sample_id")


@study_query("select subject, time, count(*) n_taxa, cast(sum(raw) as bigint) raw from cells group by 1, 2")
def j3_reads_taxa(s):
    return s.cells.groupBy("subject", "time").agg(F.count(F.lit(1)).alias("n_taxa"), F.sum("raw").alias("raw"))


@study_query("select subject, time, taxon, round(log10(case when abs > 0 then abs end), 6) log_abs, biomass is null no_biomass from ab")
def j4_absolute(s):
    return s.abundance.select("subject", "time", "taxon", lg("abs").alias("log_abs"), F.col("biomass").isNull().alias("no_biomass"))


@study_query("select s.sample_id, p.name pert, p.start, p.\"end\" from samples s left join perts p on s.subject = p.subject and s.time > p.start and s.time <= p.\"end\"")
def j5_interval_join(s):
    return R.interval_join(s.samples, s.perts).select("sample_id", "pert", "start", "end")


@study_query("""select name, subject, start, "end", case when a <= z then a end start_idx, case when a < z then z when a = z then z + 1 end end_idx from (
  select p.name, p.subject, p.start, p."end", min(case when s.time >= p.start then tidx end) a, max(case when s.time <= p."end" then tidx end) z from (select distinct name, subject, start, "end" from perts) p left join samples s on s.subject = p.subject group by all)""")
def j6_nearest_index(s):
    return R.nearest_index(s.samples, s.perts)


@study_query("""select t.subject, t.time, t.taxon_idx, t.time >= i.intro present from cells t join (select taxon_idx, min(time) intro from cells where raw > 0 group by 1) i using (taxon_idx)""")
def j9_introduced(s):
    """A taxon is there from its introduction on: the earliest time any subject shows it."""
    intro = s.cells.where("raw > 0").groupBy("taxon_idx").agg(F.min("time").alias("intro"))
    return s.cells.join(intro, "taxon_idx").select("subject", "time", "taxon_idx", (F.col("time") >= F.col("intro")).alias("present"))


@study_query("""select sample_id, cast(round((time - lo) / 0.01) as bigint) step from samples join (select subject, min(time) lo from samples group by 1) using (subject)""")
def j16_grid_step(s):
    """Sample times aligned to the simulation's integer steps."""
    lo = s.samples.groupBy("subject").agg(F.min("time").alias("lo"))
    return s.samples.join(lo, "subject").select("sample_id", F.round((F.col("time") - F.col("lo")) / 0.01).cast("bigint").alias("step"))


@study_query("""select a.family, count(*) n_taxa, min(b.idx) first_idx from taxa a join (select lower(family) lf, min(idx) idx from taxa where family <> 'NA' group by 1) b on lower(a.family) = b.lf group by 1""")
def j17_family_reference(s):
    ref = s.taxa.where("family <> 'NA'").groupBy(F.lower("family").alias("lf")).agg(F.min("idx").alias("ref"))
    return s.taxa.join(ref, F.lower("family") == F.col("lf")).groupBy("family").agg(F.count(F.lit(1)).alias("n_taxa"), F.min("ref").alias("first_idx"))


# ---------------------------------------------------------------- aggregates


@study_query("select subject, time, cast(sum(raw) as bigint) depth from cells group by 1, 2")
def a1_read_depth(s):
    return s.depth.join(s.samples, "sample_id").select("subject", "time", "depth")


@study_query("select subject, time, taxon, raw, round(rel, 6) rel from ab")
def a2_matrix(s):
    return s.abundance.select("subject", "time", "taxon", "raw", F.round("rel", 6).alias("rel"))


def _a3(agg: str, dtype: str, times: str):
    at = "select time, count(*) present from samples group by 1" if times == "union" else "select time, count(*) present from samples group by 1 having count(distinct subject) = (select count(distinct subject) from samples)"
    pick = {"sum": "sum(v)", "mean": "sum(v) / max(present)", "max": "case when count(*) < max(present) then greatest(max(v), 0) else max(v) end", "min": "case when count(*) < max(present) then least(min(v), 0) else min(v) end", "median": "list_median(list_concat(list(v), list_resize([]::double[], max(present) - count(*), 0.0)))"}[agg]
    if agg == "median":
        pick = "list_aggregate(list_concat(list(v), list_resize([]::double[], max(present) - count(*), 0.0)), 'median')"
    return f"select taxon_idx, time, round({pick}, 6) as value from (select taxon_idx, time, cast({dtype} as double) v, present from ab join ({at}) using (time)) group by 1, 2"


for _agg, _dtype, _times in (("mean", "rel", "union"), ("sum", "raw", "union"), ("max", "raw", "union"), ("min", "rel", "union"), ("median", "rel", "union"), ("sum", "raw", "intersection")):

    def _run(s, agg=_agg, dtype=_dtype, times=_times):
        return R.aggregate_over_subjects(s, dtype, agg, times).select("taxon_idx", "time", F.round("value", 6).alias("value"))

    _run.__name__ = f"a3_{_agg}_{_dtype}_{_times}"
    study_query(_a3(_agg, _dtype, _times))(_run)


@study_query("select sample_id, n, round(loc, 6) loc, round(scale, 6) as scale, round(log10(gmean), 6) log_gmean, round(log10(exp(loc + scale * scale / 2)), 6) log_mean, round((exp(scale * scale) - 1), 6) cv2 from bio")
def a4_qpcr_stats(s):
    b = s.biomass
    return b.select("sample_id", "n", F.round("loc", 6).alias("loc"), F.round("scale", 6).alias("scale"), lg("gmean").alias("log_gmean"), lg("mean_lognormal").alias("log_mean"), F.round(F.exp(F.col("scale") * F.col("scale")) - 1, 6).alias("cv2"))


@study_query("select sample_id, round(log10(max(density)), 6) log_max, round(log10(min(density)), 6) log_min, round(var_pop(ln(density)), 6) log_var from qpcr_c group by 1")
def a5_qpcr_accessors(s):
    got = s.qpcr.groupBy("sample_id").agg(F.max("density").alias("hi"), F.min("density").alias("lo"), F.round(F.var_pop(F.ln("density")), 6).alias("log_var"))
    return got.select("sample_id", lg("hi").alias("log_max"), lg("lo").alias("log_min"), "log_var")


@study_query("select round(log10(100 / max(gmean)), 6) log_factor from bio where sample_id in (select sample_id from samples)")
def a6_normalise_factor(s):
    return s.normalise_qpcr(100.0).select(lg("factor").alias("log_factor"))


def _smart(to: str) -> str:
    above = list(reversed(LEVELS[: LEVELS.index(to)]))
    cases = " ".join(f"when \"{u}\" <> 'NA' then '{u.capitalize()} ' || \"{u}\" || ', {to.capitalize()} NA'" for u in above)
    return f"case when \"{to}\" <> 'NA' then \"{to}\" {cases} else 'NA' end"


_keys5 = ", ".join(f'"{c}"' for c in LEVELS[:5])


@study_query(f"select subject, time, {_keys5}, {_smart('family')} as label, cast(sum(raw) as bigint) as value, count(distinct taxon_idx) members from cells join (select idx, {_keys5} from taxa) t on t.idx = taxon_idx group by subject, time, {_keys5}")
def a7_family(s):
    return R.cluster_by_level(s, "raw", "family").select("subject", "time", *LEVELS[:5], "label", "value", "members")


@study_query("select genus || ' | ' || family as label, time, cast(sum(raw) as bigint) as value from cells join (select idx, family, genus from taxa) t on t.idx = taxon_idx group by 1, 2")
def a8_condense_by_label(s):
    """Rows summed by a formatted label, in label order."""
    named = s.taxa.select(F.col("idx").alias("taxon_idx"), labels.format_label("%(genus)s | %(family)s").alias("label"))
    return s.cells.join(named, "taxon_idx").groupBy("label", "time").agg(F.sum("raw").alias("value"))


@study_query("select subject, time, 'OTU_' || (taxon_idx // 5) otu, cast(sum(raw) as bigint) raw from cells group by 1, 2, 3")
def a9_aggregate_items(s):
    bridge = s.taxa.select(F.concat(F.lit("OTU_"), F.floor(F.col("idx") / 5).cast("string")).alias("otu"), F.col("name").alias("taxon"))
    return R.aggregate_items(s, bridge)


@study_query("select subject, time, case when taxon_idx % 5 = 0 then taxon else 'OTU_' || (taxon_idx // 5) end otu, cast(sum(raw) as bigint) raw from cells group by 1, 2, 3")
def a11_deaggregate(s):
    """One taxon of every OTU taken out again."""
    otu = F.when(F.col("idx") % 5 == 0, F.col("name")).otherwise(F.concat(F.lit("OTU_"), F.floor(F.col("idx") / 5).cast("string")))
    return R.aggregate_items(s, s.taxa.select(otu.alias("otu"), F.col("name").alias("taxon")))


_ALPHA = "from (select subject, time, raw / sum(raw) over (partition by sample_id) p from cells where raw > 0) group by 1, 2"


@study_query(f"select subject, time, round(-sum(p * ln(p)), 6) entropy, round(case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) end, 6) normalized, round(-sum(p * ln(p)) / ln(2), 6) shannon {_ALPHA}")
def a32_alpha(s):
    p = F.col("raw") / F.sum("raw").over(Window.partitionBy("sample_id"))
    rows = s.cells.where("raw > 0").withColumn("p", p)
    h = -F.sum(F.col("p") * F.ln("p"))
    n = F.count(F.lit(1))
    return rows.groupBy("subject", "time").agg(F.round(h, 6).alias("entropy"), F.round(F.when(n > 1, h / F.ln(n)), 6).alias("normalized"), F.round(h / F.ln(F.lit(2.0)), 6).alias("shannon"))


@study_query("""select subject, tidx, round(sum(abs(a - b)) / sum(a + b), 6) braycurtis, round(sum(case when a <> b then 1 else 0 end) * 1.0 / count(*), 6) jaccard from (
  select coalesce(x.subject, y.subject) subject, coalesce(x.tidx, y.tidx - 1) tidx, coalesce(x.raw, 0) a, coalesce(y.raw, 0) b
  from (select c.* from cells c join samples s on s.subject = c.subject and s.tidx = c.tidx + 1) x full join (select * from cells where tidx > 0) y on x.subject = y.subject and y.tidx = x.tidx + 1 and x.taxon_idx = y.taxon_idx) where a > 0 or b > 0 group by 1, 2""")
def a33_beta_successive(s):
    """Bray-Curtis and Jaccard distance of each sample to the subject's next one: both sides in one shuffle."""
    c = s.cells.select("subject", "tidx", "taxon_idx", F.col("raw").cast("double").alias("v"))
    last = s.samples.groupBy("subject").agg(F.max("tidx").alias("top"))
    both = c.select("subject", "tidx", "taxon_idx", F.col("v").alias("a"), F.lit(0.0).alias("b")).union(c.select("subject", F.col("tidx") - 1, "taxon_idx", F.lit(0.0), "v")).where("tidx >= 0").join(last, "subject").where("tidx < top")
    per = both.groupBy("subject", "tidx", "taxon_idx").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 0 or b > 0")
    return per.groupBy("subject", "tidx").agg(F.round(F.sum(F.abs(F.col("a") - F.col("b"))) / F.sum(F.col("a") + F.col("b")), 6).alias("braycurtis"), F.round(F.sum((F.col("a") != F.col("b")).cast("int")) / F.count(F.lit(1)), 6).alias("jaccard"))


@study_query("select subject, taxon, round(log10(avg(raw)), 6) log_mean, round(case when count(*) > 1 and var_pop(raw) > 0 then log10(var_pop(raw)) end, 6) log_var from cells where raw > 0 group by 1, 2")
def a35_mean_variance(s):
    got = s.cells.where("raw > 0").groupBy("subject", "taxon").agg(F.avg("raw").alias("m"), F.var_pop("raw").alias("v"), F.count(F.lit(1)).alias("n"))
    return got.select("subject", "taxon", lg("m").alias("log_mean"), F.round(F.when((F.col("n") > 1) & (F.col("v") > 0), F.log10("v")), 6).alias("log_var"))


@study_query("select family, count(*) n_taxa, cast(sum(length(\"sequence\")) as bigint) letters from taxa group by grouping sets ((family), ())")
def a36_family_and_total(s):
    return s.taxa.groupingSets([["family"], []], "family").agg(F.count(F.lit(1)).alias("n_taxa"), F.sum(F.length("sequence")).cast("bigint").alias("letters"))


@study_query("select phylum, taxon_idx % 4 as cluster, round(avg(rel), 6) mean_rel from ab join (select idx, phylum from taxa) t on t.idx = taxon_idx where time < coalesce((select min(start) from perts p where p.subject = ab.subject), 1e9) group by 1, 2")
def a37_preperturbation_distribution(s):
    """Mean relative abundance before the first perturbation, by taxon label and cluster."""
    first = s.perts.groupBy("subject").agg(F.min("start").alias("first"))
    rows = s.abundance.join(first, "subject", "left").where("first is null or time < first").join(s.taxa.select(F.col("idx").alias("taxon_idx"), "phylum"), "taxon_idx")
    return rows.groupBy("phylum", (F.col("taxon_idx") % 4).alias("cluster")).agg(F.round(F.avg("rel"), 6).alias("mean_rel"))


# ---------------------------------------------------------------- windows


def _w1(rows: str, k: int, m: int) -> str:
    return f"select taxon from (select subject, taxon, tidx, lag(tidx, {k - 1}) over (partition by subject, taxon order by tidx) p from {rows}) where tidx - p = {k - 1} group by 1 having count(distinct subject) >= {m}"


@study_query(_w1("(select * from ab where rel >= 0.01 and time >= 0)", 3, 2))
def w1_consistency(s):
    return Q.consistent_taxa(s, "rel", 0.01, 3, 2)


@study_query("select taxon from (" + _w1("(select * from ab where rel >= 0.01 and subject not like 'U%')", 2, 1) + ") intersect (" + _w1("(select * from ab where rel >= 0.01 and subject not like 'U%')", 4, 1) + " union " + _w1("(select * from ab where rel >= 0.01 and subject like 'U%')", 4, 1) + ")")
def w2_conditional_consistency(s):
    u, rest = s.split_subjects(F.col("subject").startswith("U"))
    return Q.conditional_consistent_taxa(rest, u, "rel", 0.01, 4, 2, 1, -1e9)


@study_query("select subject, time, tidx, round(dt, 6) dt from (select subject, time, tidx, lead(time) over (partition by subject order by time) - time dt from samples) where dt is not null")
def w3_deltas(s):
    return Q.deltas(s.samples).withColumn("dt", F.round("dt", 6))


@study_query("""select subject, time, tidx, taxon_idx, round((ln(nx) - ln(abs)) / (nt - time), 6) y from (select subject, time, tidx, taxon_idx, abs, lead(tidx) over w ni, lead(time) over w nt, lead(abs) over w nx from ab where abs > 0
  window w as (partition by subject, taxon_idx order by tidx)) where ni = tidx + 1""")
def w4_log_growth(s):
    return Q.log_growth(s).withColumn("y", F.round("y", 6))


@study_query("""select subject, taxon_idx, time, round((select avg(b.rel) from ab b where b.subject = a.subject and b.taxon_idx = a.taxon_idx and b.time >= a.time - 4 and b.time < a.time + 4), 6) smooth from ab a where rel is not null""")
def w6_moving_average(s):
    rows = s.abundance.where("rel is not null").select("subject", "taxon_idx", "time", "rel")
    return Q.moving_average(rows, ["subject", "taxon_idx"], "time", "rel", 4.0).select("subject", "taxon_idx", "time", F.round("smooth", 6).alias("smooth"))


@study_query("""select subject, time, given from (select subject, time, true given from samples union all select g.subject, g.time, false from
  (select subject, round(lo + unnest(range(0, cast(floor(hi - lo) as bigint) + 1)) * 1.0, 6) as time from (select subject, min(time) lo, max(time) hi from samples group by 1)) g
  where not exists (select 1 from samples s where s.subject = g.subject and abs(s.time - g.time) <= 0.25))""")
def w8_step_points(s):
    return Q.step_points(s.samples, 1.0, 0.25)


@study_query("select subject, time from (select *, count(*) over (partition by subject) n from samples) where tidx = 0 or floor(tidx * 10 / n) > floor((tidx - 1) * 10 / n)")
def w9_subsample(s):
    return Q.even_subsample(s.samples, 10)


@study_query("""select subject, sample_id, cast(least(floor(r / greatest(floor(n / 3), 1)), 2) as int) bucket from (select subject, sample_id, row_number() over (partition by subject order by loc, sample_id) - 1 r, count(*) over (partition by subject) n from bio join samples using (sample_id))""")
def w10_buckets(s):
    rows = s.biomass.join(s.samples, "sample_id").select("subject", "sample_id", "loc")
    return Q.equal_buckets(rows, "loc", "sample_id", 3, ["subject"]).select("subject", "sample_id", "bucket")


@study_query("""select subject, mark, round(tidx + coalesce((mark - time) / (nx - time), 0), 6) as position from (select distinct subject, start mark from perts) join (select subject, time, tidx, lead(time) over (partition by subject order by time) nx from samples) using (subject) where mark >= time and (mark < nx or (nx is null and mark = time))""")
def w15_fractional_index(s):
    return Q.fractional_index(s.samples, s.perts.select("subject", F.col("start").alias("mark")).distinct()).withColumn("position", F.round("position", 6))


@study_query("""select g.subject, g.t as time, s.time is not null given from (select subject, t from (select distinct subject from samples) cross join (select distinct time t from samples)) g
  left join samples s on s.subject = g.subject and s.time = g.t""")
def w16_densify(s):
    """Every subject at the times of all samples."""
    return Q.densify(s.samples, s.samples)


@study_query("""select sample_id, subject, time, round(coalesce(loc, vb + (va - vb) * (time - tb) / nullif(ta - tb, 0), vb, va), 6) filled from (
  select s.sample_id, s.subject, s.time, b.loc, last_value(case when b.loc is not null then b.loc end ignore nulls) over p vb, last_value(case when b.loc is not null then s.time end ignore nulls) over p tb,
  first_value(b.loc ignore nulls) over f va, first_value(case when b.loc is not null then s.time end ignore nulls) over f ta from samples s left join bio b using (sample_id)
  window p as (partition by s.subject order by s.time rows between unbounded preceding and current row), f as (partition by s.subject order by s.time rows between current row and unbounded following))""")
def w17_interpolate(s):
    rows = s.samples.join(s.biomass.select("sample_id", "loc"), "sample_id", "left")
    return Q.interpolate(rows, ["subject"], "time", "loc").select("sample_id", "subject", "time", F.round("filled", 6).alias("filled"))


@study_query("""select subject, round(case when k = 0 then time else time + (nx - time) * k / 3 end, 6) as time, k = 0 given from (select subject, time, nx, unnest(case when nx is null then [0] else [0, 1, 2] end) k from (select subject, time, lead(time) over (partition by subject order by time) nx from samples))""")
def w18_density_points(s):
    return Q.density_points(s.samples, 2).withColumn("time", F.round("time", 6))


@study_query("select subject, sample_id, r + (c - 1) / 2.0 rank from (select subject, sample_id, rank() over (partition by subject order by depth) r, count(*) over (partition by subject, depth) c from (select sample_id, cast(sum(raw) as bigint) depth from cells group by 1) join samples using (sample_id))")
def w11_average_rank(s):
    rows = s.depth.join(s.samples, "sample_id")
    return rows.select("subject", "sample_id", R.average_rank("depth", ["subject"]).alias("rank"))


# ---------------------------------------------------------------- top-k and sets


@study_query("select taxon, cast(sum(raw) as bigint) total from cells group by 1 order by total desc, taxon limit 10")
def k1_top_taxa(s):
    return R.top_taxa(s, "raw", 10)


@study_query("select taxon, cast(sum(raw) as bigint) total from cells group by 1 order by total, taxon limit 10")
def k1_bottom_taxa(s):
    return R.top_taxa(s, "raw", 10, bottom=True)


@study_query("""select subject, time, taxon as label, round(rel, 6) rel from ab where rel is not null and taxon in (select taxon from ab group by 1 having sum(rel) is not null order by sum(rel) desc, taxon limit 5)
  union all select subject, time, 'Other', round(1 - coalesce(sum(case when taxon in (select taxon from ab group by 1 having sum(rel) is not null order by sum(rel) desc, taxon limit 5) then rel end), 0), 6) from ab where rel is not null group by 1, 2""")
def k2_top_and_other(s):
    return R.top_with_other(s, 5).withColumn("rel", F.round("rel", 6))


@study_query("select idx, name from taxa order by idx limit 20")
def k3_first_taxa(s):
    return s.taxa.orderBy("idx").limit(20).select("idx", "name")


@study_query("select name, cast(regexp_extract(name, '_(\\d+)', 1) as bigint) n from taxa where regexp_matches(name, '_\\d+')")
def k9_numeric_suffix(s):
    return s.taxa.where(F.col("name").rlike(r"_\d+")).select("name", F.regexp_extract("name", r"_(\d+)", 1).cast("bigint").alias("n")).orderBy("n", "name")


@study_query("select distinct time from samples")
def t1_times_union(s):
    return s.samples.select("time").distinct()


@study_query("select time from samples group by 1 having count(distinct subject) = (select count(distinct subject) from samples)")
def t2_times_intersection(s):
    return R.common_times(s.samples)


def _by_ordinal(s):
    """The study with each sample's place in its subject as its time, so that all subjects share some."""
    return s.replace(samples=s.samples.withColumn("time", F.col("tidx").cast("double")))


_COMMON = "(select tidx from samples group by 1 having count(distinct subject) = (select count(distinct subject) from samples))"


@study_query(f"select cast(tidx as double) as time from {_COMMON}")
def t2_ordinals_intersection(s):
    """The places in time that every subject has a sample for."""
    return R.common_times(_by_ordinal(s).samples)


@study_query(f"select taxon_idx, cast(tidx as double) as time, cast(sum(raw) as double) as value from cells where tidx in {_COMMON} group by 1, 2")
def a3_sum_raw_ordinals_intersection(s):
    return R.aggregate_over_subjects(_by_ordinal(s), "raw", "sum", "intersection")


@study_query("select distinct taxon from ab where rel >= 0.1 and subject like 'U%' union select distinct taxon from ab where rel >= 0.1 and subject like 'T%'")
def t3_union_of_cohorts(s):
    rich = s.abundance.where("rel >= 0.1")
    return rich.where("subject like 'U%'").select("taxon").union(rich.where("subject like 'T%'").select("taxon")).distinct()


@study_query("select genus, array_to_string(list_sort(list(distinct species)), '/') species from taxa where species <> 'NA' and genus <> 'NA' group by 1")
def t4_species_union(s):
    got = s.taxa.where("species <> 'NA' and genus <> 'NA'").groupBy("genus").agg(F.array_join(F.array_sort(F.collect_set("species")), "/").alias("species"))
    return got


@study_query("select c as cluster, count(*) n_outside from taxa, (select unnest([0, 1, 2, 3]) c) where idx % 4 <> c group by 1")
def t5_complement(s):
    """Non-members of each of the four clusters: all taxa less the members, from two counts."""
    n = s.taxa.groupBy((F.col("idx") % 4).alias("cluster")).agg(F.count(F.lit(1)).alias("m"))
    total = s.taxa.agg(F.count(F.lit(1)).alias("n"))
    return n.join(total).select("cluster", (F.col("n") - F.col("m")).alias("n_outside"))


@study_query("select sample_id, taxon, case when taxon_idx % 4 = 2 then 0 else raw end raw from cells")
def t6_exclude_cluster(s):
    return s.cells.select("sample_id", "taxon", F.when(F.col("taxon_idx") % 4 == 2, 0).otherwise(F.col("raw")).alias("raw"))


# ---------------------------------------------------------------- labels and sequences


@study_query("select idx, name || ': ' || genus || ' (' || idx || ') %(other)s' as label from taxa")
def c1_label(s):
    return s.taxa.select("idx", labels.format_label("%(name)s: %(genus)s (%(index)s) %(other)s").alias("label"))


_PAPER = "case when species <> 'NA' then genus || ' ' || (case when len(string_split(species, '/')) >= 3 then array_to_string(string_split(species, '/')[1:2], '/') else species end) || ' ' || name " + " ".join(f"when \"{c}\" <> 'NA' then '{'*' * i} ' || \"{c}\" || ' ' || name" for i, c in enumerate(reversed(LEVELS[:-1]), 1)) + " else 'NA ' || name end"


@study_query(f"select idx, {_PAPER} as label from taxa")
def c2_paper_label(s):
    return s.taxa.select("idx", labels.paper_label().alias("label"))


@study_query("select idx, array_to_string([" + ", ".join(f'"{c}"' for c in LEVELS) + ", name], ' > ') as lineage from taxa")
def c3_lineage(s):
    return s.taxa.select("idx", F.array_join(labels.lineage_array(), " > ").alias("lineage"))


_LIN = "[" + ", ".join(f'"{c}"' for c in LEVELS) + ", name]"


@study_query(f"select a.idx, round((case when list_position(list_transform(range(1, 9), lambda i: a.l[i] = b.l[i]), false) is null then 8 else list_position(list_transform(range(1, 9), lambda i: a.l[i] = b.l[i]), false) - 1 end) / 8, 6) similarity from (select idx, {_LIN} l from taxa) a join (select idx, {_LIN} l from taxa) b on b.idx = a.idx + 1")
def c5_similarity_to_next(s):
    """Taxonomic similarity of each taxon to the next one in order."""
    a = s.taxa.select("idx", labels.lineage_array().alias("a"))
    b = s.taxa.select((F.col("idx") - 1).alias("idx"), labels.lineage_array().alias("b"))
    return a.join(b, "idx").select("idx", F.round(labels.taxonomic_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@study_query("select idx, case when lower(phylum) in ('bacteroidetes', 'verrucomicrobia', 'proteobacteria') then true when lower(phylum) = 'firmicutes' then false end gram_negative from taxa")
def c6_gram_negative(s):
    return s.taxa.select("idx", labels.gram_negative().alias("gram_negative"))


@study_query("""select a.idx, case when length(a.s) = length(b.s) then cast(len(list_filter(range(1, length(a.s) + 1), lambda i: a.s[i] <> b.s[i] and a.s[i] <> 'N' and b.s[i] <> 'N')) as int) end distance from (select idx, "sequence" s from taxa where "sequence" is not null) a join (select idx, "sequence" s from taxa where "sequence" is not null) b on b.idx = a.idx + 1""")
def c7_hamming_to_next(s):
    """Of unequal lengths there is no distance."""
    rows = s.taxa.where("sequence is not null").select("idx", F.col("sequence").alias("s"))
    nxt = rows.select((F.col("idx") - 1).alias("idx"), F.col("s").alias("t"))
    return rows.join(nxt, "idx").select("idx", labels.hamming(F.col("s"), F.col("t")).alias("distance"))


@study_query("""select family, string_agg(case when n >= 0.65 * total then base else 'N' end, '' order by pos) consensus from (
  select family, pos, base, n, total, row_number() over (partition by family, pos order by n desc, base) k from (
  select family, pos, base, count(*) n, sum(count(*)) over (partition by family, pos) total from (select family, u.i pos, substr("sequence", u.i, 1) base from taxa, unnest(range(1, length("sequence") + 1)) u(i) where family <> 'NA') group by 1, 2, 3)) where k = 1 group by 1""")
def c8_consensus_sequence(s):
    """Majority base per place where its share reaches 0.65, else N; folded per place, never per sequence."""
    rows = s.taxa.where("length(sequence) > 0 and family <> 'NA'").select("family", F.posexplode(F.split("sequence", "")).alias("pos", "base"))
    per = rows.groupBy("family", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("family", "pos").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.ascii("base")).alias("o"), "base")).alias("b"))
    base = F.when(F.col("b.n") >= 0.65 * F.col("total"), F.col("b.base")).otherwise("N")
    return best.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("pos", base.alias("c")))).alias("x")).select("family", F.array_join(F.transform("x", lambda z: z["c"]), "").alias("consensus"))


@study_query("""select otu, case when kp = 1 then p else 'NA' end phylum, case when kp = 1 and kf = 1 then f else 'NA' end family, sp as species from (select idx // 5 otu, count(distinct phylum) kp, min(phylum) p, count(distinct family) kf, min(family) f,
  coalesce(array_to_string(list_sort(list(distinct species) filter (species <> 'NA')), '/'), 'NA') sp from taxa group by 1)""")
def c9_consensus_taxonomy(s):
    """Disagreement at a level makes it and all below undefined; species are united."""
    got = s.taxa.groupBy(F.floor(F.col("idx") / 5).alias("otu")).agg(F.count_distinct("phylum").alias("kp"), F.min("phylum").alias("p"), F.count_distinct("family").alias("kf"), F.min("family").alias("f"), F.array_sort(F.collect_set(F.when(F.col("species") != "NA", F.col("species")))).alias("sp"))
    na = F.lit("NA")
    return got.select("otu", F.when(F.col("kp") == 1, F.col("p")).otherwise(na).alias("phylum"), F.when((F.col("kp") == 1) & (F.col("kf") == 1), F.col("f")).otherwise(na).alias("family"), F.when(F.size("sp") > 0, F.array_join("sp", "/")).otherwise(na).alias("species"))


@study_query("select name, least(100, greatest(0, n)) capped from (select name, count(*) n from perts group by 1)")
def y3_perturbation_counts(s):
    return s.perts.groupBy("name").agg(F.greatest(F.lit(0), F.least(F.lit(100), F.count(F.lit(1)))).alias("capped"))


@study_query("select subject, count(*) n_samples, round(min(time), 6) first_time, round(max(time), 6) last_time from samples group by 1")
def y1_subjects(s):
    return s.samples.groupBy("subject").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.min("time"), 6).alias("first_time"), F.round(F.max("time"), 6).alias("last_time"))


@study_query("select subject, taxon, round(sum(rel), 6) total_rel from ab where taxon in (" + _w1("(select * from ab where rel >= 0.01 and time >= 0)", 3, 2) + ") group by 1, 2 order by total_rel desc")
def flagship(s):
    """Consistent taxa and their relative abundance by subject: scan, joins, aggregate, window, filter, sort."""
    kept = s.keep_taxa(Q.consistent_taxa(s, "rel", 0.01, 3, 2).withColumnRenamed("taxon", "name")).taxa.select(F.col("name").alias("taxon"))
    rows = s.abundance.join(kept, "taxon", "left_semi")
    return rows.groupBy("subject", "taxon").agg(F.round(F.sum("rel"), 6).alias("total_rel")).orderBy(F.desc("total_rel"))
