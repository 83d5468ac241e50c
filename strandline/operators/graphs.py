"""Connected components, and neighbours within a Hamming distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.labels import hamming
from strandline.session import durable


def connected_groups(nodes: DataFrame, links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, grp): the smallest node of each connected component, by alternating star contractions.

    ``nodes`` has (node), ``links`` (a, b).  Each round halves long chains; no component is gathered in one task.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is tied to the smallest of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("n", "m")
        low = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = both.join(low.hint("merge"), "n").where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        tied = large.join(least.hint("merge"), "u")
        small = tied.select(F.col("v").alias("u"), F.col("low").alias("v")).union(tied.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        new = durable(small)
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    root = edges.groupBy("u").agg(F.min("v").alias("grp"))
    return nodes.join(root.hint("merge"), nodes["node"] == root["u"], "left").select("node", F.coalesce("grp", "node").alias("grp"))


def hamming_neighbours(rows: DataFrame, most: int, pieces: int | None = None) -> DataFrame:
    """(a, b, dist), a < b: pairs of (id, seq) of equal length at most ``most`` places apart, places with N left out.

    Sequences of any length are cut into ``pieces``, some of them empty in the shortest ones.  Two such sequences share all but
    ``most`` of the pieces without N; where neither has an N each shows only its ``most`` + 1 rarest ones, and pieces in
    conserved stretches hardly ever meet.  For every piece in which the other sequence has an N, one more is shown; two with
    so many of those that no piece need be shared are compared by length alone.
    Joins are by sort-merge only: size estimates know neither the pieces that are exploded nor the letters of a text.
    """
    p = pieces or 2 * (most + 1)
    n = F.length("seq")
    at = F.sequence(F.lit(0), F.lit(p - 1))
    cut = F.transform(at, lambda k: F.struct(k.alias("k"), F.substring(F.col("seq"), F.floor(k * n / p).cast("int") + 1, (F.floor((k + 1) * n / p) - F.floor(k * n / p)).cast("int")).alias("s")))
    u = F.when(F.col("seq").contains("N"), F.size(F.filter(cut, lambda z: z["s"].contains("N")))).otherwise(0)  # pieces with an N
    size = rows.select("id", n.alias("len"), u.alias("u"))
    parts = rows.select("id", n.alias("len"), u.alias("u"), F.explode(cut).alias("z")).where(~F.col("z.s").contains("N")).select("id", "len", "u", "z.k", F.xxhash64("z.s").alias("h"))
    key = ["len", "k", "h"]
    freq = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("f"))
    w = Window.partitionBy("id").orderBy("f", "k")
    # ties of frequency break by (k, h) alike in every sequence, so the order is one order for all
    ranked = parts.join(freq.hint("merge"), key).withColumn("r", F.row_number().over(w)).where("f > 1").select("id", "u", *key, "r")
    shown = ranked.where((F.col("u") == 0) & (F.col("r") <= most + 1)).select("id", *key)
    found = shown.withColumnRenamed("id", "a").join(shown.withColumnRenamed("id", "b").hint("merge"), key).where("a < b").select("a", "b")
    # one with N and another: of a sequence's pieces most + 1 + u of the other's are shown
    mine = ranked.where("u > 0").withColumnsRenamed({"id": "x", "u": "ux", "r": "rx"})
    reach = mine.groupBy(*key).agg(F.max("ux").alias("reach"))
    theirs = ranked.join(reach.hint("merge"), key).where(F.col("r") <= most + 1 + F.col("reach")).select("id", "u", *key, "r")
    open_ = mine.join(theirs.hint("merge"), key).where((F.col("x") != F.col("id")) & (F.col("rx") <= most + 1 + F.col("u")) & (F.col("r") <= most + 1 + F.col("ux")))
    # too many pieces with N for one to be shared: p - most - ux - u is below 1
    least = p - most
    many = size.where(F.col("u") >= (least + 1) // 2).withColumnsRenamed({"id": "x", "u": "ux"})
    few = many.join(size.hint("merge"), "len").where((F.col("x") != F.col("id")) & (F.col("ux") + F.col("u") >= least))
    for other in (open_, few):
        found = found.unionByName(other.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")))
    pairs = found.distinct()
    sa, sb = rows.select(F.col("id").alias("a"), F.col("seq").alias("sa")), rows.select(F.col("id").alias("b"), F.col("seq").alias("sb"))
    return pairs.join(sa.hint("merge"), "a").join(sb.hint("merge"), "b").withColumn("dist", hamming(F.col("sa"), F.col("sb"))).where(F.col("dist") <= most).select("a", "b", "dist")


def descendants(edges: DataFrame, roots: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(root, node, steps): every node that can be reached from each of ``roots`` (node) along ``edges`` (parent, child).

    Breadth first: ``steps`` is the shortest way; a cycle ends where all its nodes are known.  Each round joins the
    edges to the nodes found in the last one.
    """
    e = durable(edges.select(F.col("parent").alias("at"), "child").distinct())
    front = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("steps", F.lit(0))
    known = front = durable(front)
    for step in range(1, max_rounds + 1):
        nxt = front.withColumnRenamed("node", "at").join(e, "at").select("root", F.col("child").alias("node")).distinct()
        front = durable(nxt.join(known, ["root", "node"], "left_anti").withColumn("steps", F.lit(step)))
        if front.isEmpty():
            return known.where("steps > 0")
        known = known.unionByName(front)
    raise RuntimeError("the way down did not end; raise max_rounds")


def node_degrees(edges: DataFrame) -> DataFrame:
    """(node, n_parents, n_children) over the distinct edges (parent, child)."""
    e = edges.select("parent", "child").distinct()
    ends = e.select(F.col("child").alias("node"), F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(e.select(F.col("parent").alias("node"), F.lit(0).alias("p"), F.lit(1).alias("c")))
    return ends.groupBy("node").agg(F.sum("p").alias("n_parents"), F.sum("c").alias("n_children"))
