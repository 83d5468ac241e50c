"""Queries over cluster operations, species sources, masks and model graphs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import clusters as C
from strandline.operators import graphs as G
from strandline.operators import posterior as P
from strandline.plans import posterior_queries as PQ
from strandline.plans import study_queries as SQ
from strandline.sources import dataset as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _adder(register, module):
    def by_sql(sql: str | None = None):
        def add(f):
            register(sql)(f)
            QUERIES[f.__name__] = module.QUERIES.pop(f.__name__)
            if sql is not None:
                ORACLE[f.__name__] = module.ORACLE.pop(f.__name__)
            return f

        return add

    return by_sql


study, traces = _adder(SQ.study_query, SQ), _adder(PQ.query, PQ)

# ---------------------------------------------------------------- sources


def _second_species(s):
    """A second source of species: what the first taxon of the same genus has."""
    first = s.taxa.groupBy("genus").agg(F.min(F.struct("idx", "species"))["species"].alias("species"))
    return s.taxa.select("name", "genus").join(first, "genus").select("name", "species")


_RDP = """, r as (select genus, arg_min(species, idx) rdp from taxa group by 1), b as (select idx, name, species silva, rdp from taxa join r using (genus)),
n as (select idx, name, list_filter(list_transform(string_split(silva, '/'), lambda v: trim(v)), lambda v: v <> '') a, list_filter(list_transform(string_split(rdp, '/'), lambda v: trim(v)), lambda v: v <> '') b from b),
u as (select idx, name, list_sort(list_filter(list_distinct(list_concat(a, b)), lambda v: v <> 'NA')) k, list_sort(list_filter(list_distinct(b), lambda v: v <> 'NA')) r from n)
"""


@study(_RDP + "select idx, name, case when len(k) between 1 and 2 then array_to_string(k, '/') else 'NA' end species from u")
def s3_species_both(s):
    """Species from both sources: their union, undefined beyond two names."""
    return D.with_species(s.taxa, _second_species(s), "both").select("idx", "name", "species")


@study(_RDP + "select idx, name, case when len(r) between 1 and 2 then array_to_string(r, '/') else 'NA' end species from u")
def s3_species_rdp(s):
    return D.with_species(s.taxa, _second_species(s), "rdp").select("idx", "name", "species")


_COHORT = "split_part(sample_id, '-', 1) in (select split_part(sample_id, '-', 1) from samples group by 1 having count(*) >= 30)"


def _many_sampled(s):
    part = F.split_part("sample_id", F.lit("-"), F.lit(1))
    many = s.samples.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n >= 30").select("p")
    return D.of_cohort(s, [r["p"] for r in many.collect()])  # the subjects of a cohort


@study(f"""select k, n from (select 'samples' k, count(*) n from samples where {_COHORT} union all select 'reads', count(*) from reads where sample_id in (select sample_id from samples where {_COHORT})
  union all select 'qpcr', count(*) from qpcr_c where sample_id in (select sample_id from samples where {_COHORT}) union all select 'perts', count(*) from perts where subject in (select subject from samples where {_COHORT}))""")
def s2_cohort(s):
    """Rows of each table that belong to the cohort of subjects with 30 samples or more."""
    c = _many_sampled(s)
    n = lambda df, k: df.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"))
    return n(c.samples, "samples").unionByName(n(c.reads, "reads")).unionByName(n(c.qpcr, "qpcr")).unionByName(n(c.perts, "perts"))


@study(f"select reading_id, sample_id, round(log10(density), 6) log_density from qpcr_c where sample_id in (select sample_id from samples where {_COHORT})")
def s5_qpcr_of_cohort(s):
    return _many_sampled(s).qpcr.select("reading_id", "sample_id", F.round(F.log10("density"), 6).alias("log_density"))


_MASK = ", m as (select name taxon, null subject, 3.0 time_from from taxa where idx % 3 = 0 union all select name, subject, 10.0 from taxa cross join (select distinct subject from samples where subject like 'U%') where idx % 4 = 0)"


def _mask(s):
    every = s.taxa.where("idx % 3 = 0").select(F.col("name").alias("taxon"), F.lit(None).cast("string").alias("subject"), F.lit(3.0).alias("time_from"))
    # rows of taxa and subjects that have cells together; others mask nothing, and are taxa times subjects
    met = s.cells.where("subject like 'U%' and taxon_idx % 4 = 0").select("taxon", "subject").distinct()
    own = met.select("taxon", "subject", F.lit(10.0).alias("time_from"))
    return every.unionByName(own)


@study(_MASK + """ select c.taxon_idx, count(*) n_present from cells c where not exists (select 1 from m where m.taxon = c.taxon and (m.subject is null or m.subject = c.subject) and c.time < m.time_from) group by 1""")
def b10_structural_zeros(s):
    """Cells left by a zero-inflation mask: taxa that come in later, in all subjects or in those of a cohort."""
    return D.present_cells(s, _mask(s)).groupBy("taxon_idx").agg(F.count(F.lit(1)).alias("n_present"))


# ---------------------------------------------------------------- clusters


_MEM = "(select idx item, idx % 7 cid from taxa)"


def _members(s, col: str = "idx"):
    return s.taxa.select(F.col(col).alias("item"), (F.col("idx") % 7).alias("cid"))


@study(f"select item, case when item % 10 = 0 then 100 when item % 5 = 0 then cid + 1 else cid end cid from {_MEM} where item % 11 <> 0 or (item % 5 = 0)")
def t8_move_items(s):
    """Every fifth item moves to the next cluster, every tenth to a new one; every eleventh other one leaves."""
    moves = s.taxa.where("idx % 5 = 0").select(F.col("idx").alias("item"), F.when(F.col("idx") % 10 == 0, 100).otherwise(F.col("idx") % 7 + 1).alias("to"))
    gone = s.taxa.where("idx % 11 = 0 and idx % 5 <> 0").select(F.col("idx").alias("item"), F.lit(None).cast("int").alias("to"))
    return C.move_items(_members(s), moves.unionByName(gone))


@study(f"select item, case when item % 50 = 3 then 6 + row_number() over (partition by item % 50 = 3 order by item) else cid end cid from {_MEM}")
def t8_own_clusters(s):
    items = s.taxa.where("idx % 50 = 3").select(F.col("idx").alias("item"))
    return C.own_cluster(_members(s), items).select("item", F.col("cid").cast("bigint").alias("cid"))


@study("""select name, 'left' side from taxa where genus <> 'NA' and name not in (select name from taxa where family <> 'NA' and idx % 2 = 0)
  union all select name, 'right' from taxa where family <> 'NA' and idx % 2 = 0 and name not in (select name from taxa where genus <> 'NA')""")
def j12_mismatched_names(s):
    """Names that only one of two clusterings has."""
    return C.mismatched_names(s.taxa.where("genus <> 'NA'"), s.taxa.where("family <> 'NA' and idx % 2 = 0"))


@study("select idx, name, dense_rank() over (order by genus) cid from taxa where genus <> 'NA'")
def j12_take_clustering(s):
    """A clustering of another study by genus, taken over by taxon name."""
    genera = s.taxa.where("genus <> 'NA'")
    ids = genera.groupBy("genus").agg(F.count(F.lit(1)).alias("n")).withColumn("cid", F.row_number().over(Window.orderBy("genus")))  # a row a genus
    return C.take_clustering(s.taxa, genera.join(ids, "genus").select("name", "cid"))


_KY = "(select phylum as cluster, avg(rel) ky from ab join (select idx, phylum from taxa) t on t.idx = taxon_idx group by 1)"


def _ky(s):
    t = s.taxa.select(F.col("idx").alias("taxon_idx"), F.col("phylum").alias("cluster"))
    return s.abundance.join(t, "taxon_idx").groupBy("cluster").agg(F.avg("rel").alias("ky"))


@study(f"select cluster, round(ky, 9) ky, row_number() over (order by ky desc nulls last, cluster) place from {_KY}")
def k6_keystone_order(s):
    return C.order_by_keystoneness(_ky(s)).select("cluster", F.round("ky", 9).alias("ky"), F.col("place").cast("bigint").alias("place"))


@study(f"select cluster, round(sqrt(ky / top), 6) shade from {_KY}, (select max(ky) top from {_KY})")
def c15_signed_root(s):
    ky = _ky(s)
    top = ky.agg(F.max("ky").alias("top"))
    return ky.join(F.broadcast(top)).select("cluster", F.round(C.signed_root_norm("ky", "top"), 6).alias("shade"))


@traces("select chain, gibbs, idx, round(value, 6) as value from growth where value > 0.25")
def c14_out_of_range(t):
    return C.out_of_range(t.growth, "value", 0.0, 0.25).withColumn("value", F.round("value", 6))


_SIM = """, sim as (select gibbs * 4 + chain gibbs, cast(k.d as double) as time, tgt taxon, exp(10 * x + k.d / 10.0) x from e, (select unnest(range(17, 22)) d) k where src = 0)"""


@traces(_SIM + " select taxon % 3 cid, round(log10(sum(x)), 6) log_biomass from (select taxon, avg(x) x from sim where time = 19 group by 1) group by 1")
def a14_day_biomass(t):
    """Biomass of every cluster on day 20, the grid's index 19."""
    days = F.explode(F.sequence(F.lit(17), F.lit(21))).alias("d")
    sim = t.cells.where("src = 0").select(F.col("tgt").alias("taxon"), "x", days)
    sim = sim.select("taxon", F.col("d").cast("double").alias("time"), F.exp(10 * F.col("x") + F.col("d") / 10).alias("x"))
    mem = t.growth.select(F.col("idx").alias("taxon"), (F.col("idx") % 3).alias("cid")).distinct()
    return C.day_biomass(sim, mem).select("cid", F.round(F.log10("biomass"), 6).alias("log_biomass"))


@study("""select subject, time, otu, cast(sum(raw) as bigint) raw from (select c.subject, c.time, c.raw, coalesce(o.family, c.taxon) otu from cells c join (select name, family from taxa) t on t.name = c.taxon
  left join (select family from taxa where family <> 'NA' group by 1 having count(*) >= 2) o on o.family = t.family) group by 1, 2, 3""")
def a10_aggregate_like(s):
    """Reads by the OTUs of another study: families of two taxa or more; other taxa stand for themselves."""
    named = s.taxa.where("family <> 'NA'").groupBy(F.col("family").alias("otu")).agg(F.collect_list("name").alias("components"))
    return C.aggregate_items_like(s, named.where("size(components) >= 2")).select("subject", "time", "otu", "raw")


@study("""select subject, time from (select subject, unnest(range(cast(ceil(min(time)) as bigint), cast(floor(max(time)) as bigint) + 1)) as time from samples group by 1 having ceil(min(time)) <= floor(max(time))) g
  where not exists (select 1 from samples s where s.subject = g.subject and s.time = g.time)""")
def f21_intermediate(s):
    """Whole days within a subject's span that may stand between its samples: those without one."""
    span = s.samples.groupBy("subject").agg(F.ceil(F.min("time")).alias("a"), F.floor(F.max("time")).alias("z")).where("a <= z")
    grid = span.select("subject", F.explode(F.sequence("a", "z")).alias("time"))
    days = grid.select("subject", F.col("time").cast("double").alias("time"))
    return C.intermediate_points(days, s.samples).select("subject", F.col("time").cast("bigint").alias("time"))


@traces("select chain, gibbs, tgt, round(list_sum(list_transform(range(0, 8), lambda k: coalesce(m[k + 1], 0) * (k + 1))), 5) as weighed, len(m) n from (select chain, gibbs, tgt, list(case when tgt <> src and abs(x) >= 0.05 then x end order by src) m from e group by 1, 2, 3)")
def m9_dense_rows(t):
    """Rows of the interaction matrix as dense arrays, shown by their length and a weighted sum."""
    rows = C.dense(t.edge.where("value is not null"), ["chain", "gibbs", "tgt"], "src")
    weighed = F.aggregate(F.transform("values", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("chain", "gibbs", "tgt", F.round(weighed, 5).alias("weighed"), F.size("values").cast("bigint").alias("n"))


@study("select taxon_idx, count(*) filter (raw <> 0) = 0 blank from cells group by 1")
def r9_blank(s):
    return C.all_zero_or_null(s.cells.withColumn("x", F.col("raw").cast("double")), ["taxon_idx"], "x")


# ---------------------------------------------------------------- graphs


_TREE = "(select distinct coalesce(nullif(phylum, ''), 'NA') parent, phylum || '|' || family child from taxa union select distinct phylum || '|' || family, phylum || '|' || family || '|' || genus from taxa union select distinct phylum || '|' || family || '|' || genus, name from taxa)"


def _lineage_edges(s):
    a, b, c = F.col("phylum"), F.concat_ws("|", "phylum", "family"), F.concat_ws("|", "phylum", "family", "genus")
    steps = [(a, b), (b, c), (c, F.col("name"))]
    return s.taxa.select(F.explode(F.array(*[F.struct(p.alias("parent"), q.alias("child")) for p, q in steps])).alias("z")).select("z.*").distinct()


@study(f", edges as {_TREE}, d0 as (select distinct phylum root, phylum node from taxa), d1 as (select root, child node from d0 join edges on parent = node), d2 as (select root, child node from d1 join edges on parent = node), d3 as (select root, child node from d2 join edges on parent = node) "
       "select root, node, 1 steps from d1 union select root, node, 2 from d2 union select root, node, 3 from d3")
def g10_descendants(s):
    """All nodes under each phylum, and how far down."""
    return G.descendants(_lineage_edges(s), s.taxa.select(F.col("phylum").alias("node")).distinct())


@study(f"select node, cast(sum(p) as bigint) n_parents, cast(sum(c) as bigint) n_children from (select child node, 1 p, 0 c from {_TREE} union all select parent, 0, 1 from {_TREE}) group by 1")
def g10_degrees(s):
    return G.node_degrees(_lineage_edges(s))


# ---------------------------------------------------------------- sparse traces: the answers of the dense ones


def _sparse(t):
    return t.edge.where("value is not null")


@traces(PQ._sum("tgt, src", "edge", "coalesce(value, 0)"))
def r4_edge_matrices_sparse(t):
    """The edge summaries from a trace that has no row for an edge that is off."""
    n = t.n_draws.agg(F.sum("n")).first()[0]
    return PQ.rounded(P.summary(_sparse(t), ["tgt", "src"], draws=int(n)), "mean", "p25", "median", "p75")


@traces(PQ._BF)
def a18_bayes_factors_sparse(t):
    n = t.n_draws.agg(F.sum("n")).first()[0]
    return PQ.rounded(P.bayes_factors(_sparse(t), ["tgt", "src"], 1.0, 4.0, draws=int(n)), "bf")


@traces(", growth_edges as (select chain, gibbs, tgt * 8 + src idx, coalesce(value, 0) as value from edge), " + PQ._MOM.replace("growth", "growth_edges") + " select idx, round(w, 6) w, round(b, 6) b from vv")
def a27_r_hat_sparse(t):
    rows = _sparse(t).select("chain", "gibbs", (F.col("tgt") * 8 + F.col("src")).alias("idx"), "value")
    return PQ.rounded(P.r_hat(rows, ["idx"], lengths=t.n_draws).select("idx", "w", "b"), "w", "b")
