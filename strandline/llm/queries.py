"""Queries of the text problems (p1, p7, p8, p9) and the SQL that states what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.leakage import leaked_items
from strandline.llm.near_dup import near_duplicate_groups, near_duplicate_pairs, similar_classes
from strandline.llm.packing import CAPACITY, pack, token_sizes
from strandline.llm.reading_level import reading_levels
from strandline.session import durable, read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicate_pairs(read_table(spark, d, "taxonomy"))
    return pairs.select(F.col("id_a").cast("int").alias("idx_a"), F.col("id_b").cast("int").alias("idx_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its class of equal sequences, its connected group and its number of links."""
    return near_duplicate_groups(read_table(spark, d, "taxonomy")).select(F.col("id").alias("idx"), "rep", "grp", "copies", "links")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The similar pairs of classes of equal sequences, each class named by its smallest idx."""
    got = similar_classes(read_table(spark, d, "taxonomy"))
    return got.select("rep_a", "rep_b", "both", "either")


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_sizes(read_table(spark, d, "documents")))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    per = p7_assignment(spark, d).groupBy("container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("fill"), F.ceil(F.sum("used") / CAPACITY).alias("least_containers"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What every assignment must hold to, counted: documents, containers over capacity, texts cut without need, and
    texts whose pieces don't follow one another from token 0."""
    got = durable(p7_assignment(spark, d))
    over = got.groupBy("container").agg(F.sum("tokens").alias("used")).where(F.col("used") > CAPACITY).agg(F.count(F.lit(1)).alias("n_over"))
    per = got.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("piece").alias("top"), F.max("start").alias("last"))
    needless = F.count_if((F.col("n") > 1) & (F.col("tokens") <= (F.col("n") - 1) * CAPACITY))
    broken = F.count_if((F.col("top") != F.col("n") - 1) | (F.col("last") != F.col("top") * CAPACITY))
    return per.agg(F.count(F.lit(1)).alias("n_docs"), needless.alias("n_needless"), broken.alias("n_broken")).join(F.broadcast(over))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return leaks.where("dist = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with up to one word edited in a run of ten."""
    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(read_table(spark, d, "documents")).select("doc_id", "band")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per band, how many the model alone puts there, and how many it was sure of."""
    levels = reading_levels(read_table(spark, d, "documents"))
    agreed, sure = (F.sum(c.cast("int")) for c in (F.col("model_band") == F.col("band"), F.col("sure")))
    return levels.groupBy("band").agg(
        F.count(F.lit(1)).alias("n_docs"), agreed.alias("n_agreed"), sure.alias("n_sure"), F.round(F.avg("level"), 4).alias("mean_level"), F.sum("n_words").alias("n_words"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_groups, p1_classes, p7_assignment, p7_fill, p7_checks, p8_found, p8_near, p9_found, p9_profile)
}

_PLAIN = "regexp_replace(regexp_replace(text, '</?\\p{L}[^>]*>', ' ', 'g'), '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{00AD}]', '', 'g')"
_LEVELS = f"""
with t as (select doc_id, {_PLAIN} x from documents where text is not null),
w as (select doc_id, x, regexp_extract_all(x, '\\p{{L}}+') w from t),
s as (select doc_id, len(w) nw, len(list_filter(w, lambda v: length(v) > 6)) nl,
  len(list_filter(string_split(regexp_replace(regexp_replace(x, '([.!?])\\s+(\\p{{Lu}})', '\\1\x1e\\2', 'g'), '(\\r\\n|\\r|\\n)[\\t\\v\\f ]*(\\r\\n|\\r|\\n)', '\x1e', 'g'), '\x1e'), lambda v: regexp_matches(v, '\\p{{L}}'))) ns from w),
l as (select doc_id, nw, nw / ns + 100.0 * nl / nw as level from s where nw >= 30),
b as (select doc_id, nw, level, cast(case when level < 30 then 1 when level < 45 then 2 when level < 60 then 3 else 4 end as int) band from l)
"""

#: pairs (i, j) of rows that share c shingles of ni and nj, and the representative r of each row's class
_P1 = """
with recursive s as (select idx, replace(upper(regexp_replace(sequence, '[\\s-]', '', 'g')), 'U', 'T') x from taxonomy where sequence is not null),
k as (select idx, x, min(idx) over (partition by x) r from s where length(x) >= 10),
g as (select distinct idx, substr(x, i, 10) g from k, unnest(range(1, length(x) - 8)) u(i)),
n as (select idx, count(*) n from g group by 1),
p as (select a.idx i, b.idx j, count(*) c from g a join g b on a.g = b.g and a.idx < b.idx group by 1, 2),
f as materialized (select i, j, c, na.n + nb.n - c e from p join n na on i = na.idx join n nb on j = nb.idx where c >= 0.7 * (na.n + nb.n - c) - 1e-9),
l as materialized (select i a, j b, c, e from f where i in (select r from k) and j in (select r from k)),
u as (select a, b from l union select b, a from l),
w as (select r node, r grp from k union select u.b, w.grp from w join u on u.a = w.node),
t as (select node, min(grp) grp from w group by 1)
"""

ORACLE: dict[str, str] = {
    "p1_found": _P1 + "select i idx_a, j idx_b from f",
    "p1_classes": _P1 + "select a rep_a, b rep_b, c \"both\", e \"either\" from l",
    "p1_groups": _P1
    + """select idx, k.r rep, t.grp, count(*) over (partition by k.r) copies, (select count(*) from u where u.a = k.r) links
      from k join t on t.node = k.r""",
    "p7_checks": "select count(distinct doc_id) n_docs, 0::bigint n_needless, 0::bigint n_broken, 0::bigint n_over from documents where text is not null",
    "p8_found": f"""
      with d as (select doc_id, list_transform(regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{Nd}}]+'), lambda v: lower(v)) w from documents where text is not null),
      i as (select item_id, list_transform(regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{Nd}}]+'), lambda v: lower(v)) w from eval_items where text is not null),
      dr as (select doc_id, array_to_string(w[k:k + 9], ' ') r from d, unnest(range(1, len(w) - 8)) u(k)),
      ir as (select item_id, array_to_string(w[k:k + 9], ' ') r from i, unnest(range(1, len(w) - 8)) u(k))
      select distinct doc_id, item_id from dr join ir using (r)""",
    "p8_near": f"""
      with d as (select doc_id, list_transform(regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{Nd}}]+'), lambda v: lower(v)) w from documents where text is not null),
      i as (select item_id, list_transform(regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{Nd}}]+'), lambda v: lower(v)) w from eval_items where text is not null),
      r as materialized (select distinct item_id, k pos, w[k:k + 9] p, array_to_string(w[k:k + 9], ' ') s from i, unnest(range(1, len(w) - 8)) u(k)),
      g as (select distinct array_to_string(w[k:k + 3], ' ') x from i, unnest(range(1, len(w) - 2)) u(k)),
      c as (select doc_id, k, w[k:k + 10] c from d, unnest(range(1, len(w) - 2)) u(k)),
      f as (select doc_id, k, c, array_to_string(c[1:4], ' ') in (select x from g) ok from c),
      m as (select doc_id, c, ok or coalesce(lead(ok, 5) over o or lead(ok, 6) over o or lead(ok, 7) over o, false) m from f window o as (partition by doc_id order by k)),
      t as materialized (select distinct doc_id, c[1:9] a, c[1:10] b, c from m where m),
      rk as materialized (select distinct array_to_string(p[1:j - 1] || p[j + 1:], ' ') x, j, s from r, unnest(range(1, 11)) u(j)),
      e as (
        select doc_id, s, 0 dist from t join (select distinct s from r) on s = array_to_string(b, ' ')
        union select doc_id, s, 1 from t join rk on x = array_to_string(a, ' ') where len(a) = 9
        union select doc_id, s, 1 from (select doc_id, j, array_to_string(b[1:j - 1] || b[j + 1:], ' ') x from t, unnest(range(1, 11)) u(j) where len(b) = 10) join rk using (x, j)
        union select doc_id, s, 1 from (select doc_id, array_to_string(c[1:j - 1] || c[j + 1:], ' ') x from t, unnest(range(1, 12)) u(j) where len(c) = 11) join (select distinct s from r) on s = x)
      select doc_id, item_id, cast(min(dist) as int) dist, cast(count(distinct pos) as int) runs from e join r using (s) group by 1, 2""",
    "p9_found": _LEVELS + "select doc_id, band from b",
}
