"""Queries of the core problems (p2 to p6) and the SQL that states what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import latest, sample_key
from strandline.operators.control_chart import implausible_readings, judged_readings
from strandline.operators.intervals import periods_and_gaps, study_intervals
from strandline.operators.orphans import study_orphans
from strandline.operators.packed_values import split_packed
from strandline.operators.regular_grid import regular_grid, study_samples
from strandline.session import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    split = split_packed(read_table(spark, d, "taxonomy"), "idx", "species")
    return split.where("n_values >= 2").select(F.col("id").cast("int").alias("idx"), "pos", "value")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """How many fields each species stands in, over all fields."""
    split = split_packed(read_table(spark, d, "taxonomy"), "idx", "species")
    return split.groupBy("value").agg(F.countDistinct("id").alias("n_taxa"), F.count(F.lit(1)).alias("n_places"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(read_table(spark, d, "qpcr"), read_table(spark, d, "metadata"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select(F.col("id").cast("bigint").alias("reading_id"))


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select(F.col("id").alias("reading_id"), "impossible", "spike", "stuck", F.col("run_length").cast("bigint").alias("run_length"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The days that the merge had to fill from both sides, a sample's time being its own value, or to mark as a gap."""
    grid = regular_grid(study_samples(read_table(spark, d, "metadata")).withColumn("value", F.col("t")), 1.0, 7.0)
    return grid.where(F.col("state").isin("filled", "gap")).select(F.col("source").alias("subject"), F.col("cell").alias("day"))


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean log10 density of each subject, gaps of up to 7 days filled."""
    rows = judged_readings(read_table(spark, d, "qpcr"), read_table(spark, d, "metadata"))
    dens = F.col("raw") * F.col("dilution") / F.col("mass")
    rows = rows.where("raw > 0 and raw < double('Infinity') and mass > 0 and time is not null").select("source", F.col("time").alias("t"), F.log10(dens).alias("value"))
    out = regular_grid(rows, 1.0, 7.0)
    return out.select(F.col("source").alias("subject"), F.col("cell").alias("day"), "n_readings", F.round("value", 6).alias("value"), F.col("t_before"), F.col("t_after"), "state")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = periods_and_gaps(study_intervals(read_table(spark, d, "perturbations")), ["subject", "name"], "start_hour", "end_hour")
    return out.select("kind", "subject", "name", F.col("start").alias("start_hour"), F.col("end").alias("end_hour"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return study_orphans(*(read_table(spark, d, t) for t in ("metadata", "qpcr", "counts", "perturbations")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_key", "period", "kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphaned keys per table, month and kind."""
    return _orphans(spark, d).groupBy("ref_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_keys"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_values, p3_found, p3_flags, p4_found, p4_series, p5_found, p6_found, p6_report)
}

KEY = "nullif(upper(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '')"

#: one match per piece: a quoted value that ends at a mark, or letters and bracketed parts up to a mark
_P2 = r"""
with f as (select idx, trim(species) s from taxonomy where species is not null),
g as (select idx, case when s like '[%]' then s[2:-2] else s end s from f),
m as (select idx, unnest(regexp_extract_all(s || ';', '\s*("(?:[^"]|"")*"|''(?:[^'']|''\w)*''|(?:[^,;/|&+\t("'']|[^,;/|&+\t("''\s][''"]|\([^()]*\))*)\s*[,;/|&+\t]', 1)) v,
      generate_subscripts(regexp_extract_all(s || ';', '\s*("(?:[^"]|"")*"|''(?:[^'']|''\w)*''|(?:[^,;/|&+\t("'']|[^,;/|&+\t("''\s][''"]|\([^()]*\))*)\s*[,;/|&+\t]', 1), 1) k from g),
c as (select idx, k, trim(v) v from m),
e as (select idx, k, case when v like '"%"' then replace(v[2:-2], '""', '"') when v like '''%''' then v[2:-2] else v end as value from c),
n as (select idx, value, row_number() over (partition by idx order by k) pos, count(*) over (partition by idx) n from e where value not in ('', 'NA'))
"""

_JUDGED = f"""
with m as (select {KEY.format('sampleid')} sample, max({KEY.format('subject')}) subject, max(case when not isnan(time) then time end) t, max(withdrawn_at) gone from metadata group by 1),
q as (select reading_id, max_by({KEY.format('sampleid')}, loaded_at) sample, max_by(rep, loaded_at) rep, max_by(cfu, loaded_at) cfu, max_by(mass, loaded_at) mass, max_by(dilution, loaded_at) dilution from qpcr where cfu is not null group by 1),
j as (select q.*, subject, t from q join m using (sample) where gone is null and subject is not null),
x as (select *, not isfinite(cfu) or cfu < 0 or mass <= 0 or (cfu * dilution / nullif(mass, 0) > 1e14 and not isnan(mass)) as impossible,
      case when isfinite(cfu) and cfu > 0 and mass > 0 and not isnan(mass) and cfu * dilution / mass > 0 then log10(cfu * dilution / mass) end lx from j),
d as (select reading_id, subject, lx, median(lx) over (partition by subject) mid, count(*) over (partition by subject) n from x where lx is not null),
s as (select reading_id from (select *, median(abs(lx - mid)) over (partition by subject) spread from d where n >= 10) where abs(lx - mid) > 10 * spread),
r as (select reading_id, subject, rep, case when isfinite(cfu) and cfu > 0 then cfu end v, row_number() over w i, row_number() over w - row_number() over (partition by subject, rep, case when isfinite(cfu) and cfu > 0 then cfu end order by t, sample, reading_id) isle
      from x where t is not null window w as (partition by subject, rep order by t, sample, reading_id)),
k as (select reading_id, count(*) over (partition by subject, rep, v, isle) n from r where v is not null),
fl as (select reading_id, coalesce(impossible, false) impossible, reading_id in (select reading_id from s) spike, reading_id in (select reading_id from k where n >= 5) stuck,
      case when reading_id in (select reading_id from k where n >= 5) then (select n from k where k.reading_id = x.reading_id) else 0 end run_length from x)
"""

_P5 = """
with r as (select nullif(upper(regexp_replace(subject, '^\\s+|\\s+$', '', 'g')), '') subject, lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) as name, cast(round(start * 24) as bigint) s, cast(round("end" * 24) as bigint) e
  from perturbations where not isnan(start) and not isnan("end") and "end" > start and subject is not null),
a as (select *, case when s <= max(e) over (partition by subject, name order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end new from r where subject is not null),
b as (select *, sum(new) over (partition by subject, name order by s, e rows unbounded preceding) g from a),
p as (select subject, name, min(s) s, max(e) e from b group by subject, name, g),
l as (select *, lead(s) over (partition by subject, name order by s) nx from p)
select 'period' kind, subject, name, s start_hour, e end_hour from p
union all select 'gap', subject, name, e, nx from l where nx is not null
"""

_P6 = f"""
with k as (select 'sample' sp, {KEY.format('sampleid')} k, loaded_at, withdrawn_at from metadata union all select 'subject', {KEY.format('subject')}, loaded_at, withdrawn_at from metadata),
p as (select sp, k, min(loaded_at) f, case when count(*) = count(withdrawn_at) then max(withdrawn_at) end g from k where k is not null group by 1, 2),
r as (select 'qpcr' ref_table, 'sample' sp, {KEY.format('sampleid')} k, loaded_at as ld from qpcr union all select 'counts', 'sample', {KEY.format('sampleid')}, loaded_at from counts
  union all select 'perturbations', 'subject', {KEY.format('subject')}, loaded_at from perturbations),
o as (select distinct ref_table, r.k ref_key, strftime(ld, '%Y-%m') period, case when p.k is null then 'missing' when ld < f then 'late' when g <= ld then 'withdrawn' end kind
  from r left join p using (sp, k) where r.k is not null)
"""

_SAMPLES = f"select {KEY.format('subject')} subject, time t from metadata where withdrawn_at is null and time is not null and not isnan(time)"

ORACLE: dict[str, str] = {
    "p2_found": _P2 + "select idx, cast(pos as int) pos, value from n where n >= 2",
    "p2_values": _P2 + "select value, count(distinct idx) n_taxa, count(*) n_places from n group by value",
    "p3_found": _JUDGED + "select reading_id from fl where impossible or spike or stuck",
    "p3_flags": _JUDGED + "select * from fl where impossible or spike or stuck",
    "p4_found": f"""with s as (select distinct subject, cast(floor(t) as bigint) d from ({_SAMPLES}) where subject is not null),
      b as (select subject, min(d) a, max(d) z from s group by 1)
      select b.subject, u.day from b, lateral (select unnest(range(a, z + 1)) as day) u where not exists (select 1 from s where s.subject = b.subject and s.d = u.day)""",
    "p4_series": _JUDGED
    + """, o as (select subject, t, lx v, cast(floor(t) as bigint) c from x where lx is not null and t is not null),
      i as (select subject, t, avg(v) v, any_value(c) c from o group by subject, t),
      cc as (select subject, c, count(*) n, avg(v) v from o group by 1, 2),
      g as (select subject, unnest(range(a, z + 1)) as day from (select subject, min(c) a, max(c) z from cc group by 1)),
      n as (select g.subject, g.day, coalesce(cc.n, 0) n, cc.v,
        (select max(t) from i where i.subject = g.subject and i.c < g.day) tb, (select min(t) from i where i.subject = g.subject and i.c > g.day) ta from g left join cc on cc.subject = g.subject and cc.c = g.day),
      h as (select n.*, ib.v vb, ia.v va from n left join i ib on ib.subject = n.subject and ib.t = tb left join i ia on ia.subject = n.subject and ia.t = ta)
      select subject, day, n n_readings, round(case when n > 0 then v when ta - tb <= 7 then vb + (va - vb) * (day - tb) / (ta - tb) end, 6) as value, tb t_before, ta t_after,
        case when n > 0 then 'observed' when ta - tb <= 7 then 'filled' else 'gap' end state from h""",
    "p5_found": _P5,
    "p6_found": _P6 + "select ref_table, ref_key, period, kind from o where kind is not null",
    "p6_report": _P6 + "select ref_table, period, kind, count(*) n_keys from o where kind is not null group by 1, 2, 3",
}
