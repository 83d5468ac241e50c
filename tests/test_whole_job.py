"""Queries that once did a part of the job, on hand-made deliveries."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from strandline.operators.study import LEVELS
from strandline.plans import registry

T0 = dt.datetime(2024, 1, 1)
SAMPLES = {"A-1": ("A", 0.0), "A-2": ("A", 1.5), "A-3": ("A", 3.0), "B-1": ("B", 0.25), "B-2": ("B", 1.5)}


@pytest.fixture(scope="module")
def deliver(spark, tmp_path_factory):
    """Writes the five tables of a study; returns their directory."""

    def run(taxa=(), counts=(), qpcr=()):
        d = str(tmp_path_factory.mktemp("delivery"))
        levels = ", ".join(f"`{c}` string" for c in LEVELS)
        rows = {
            "taxonomy": ([(i, n, q, *(lv or [None] * 7)) for i, (n, q, lv) in enumerate(taxa)], f"idx int, name string, sequence string, {levels}"),
            "metadata": ([(k, s, t, T0, None) for k, (s, t) in SAMPLES.items()], "sampleid string, subject string, time double, loaded_at timestamp, withdrawn_at timestamp"),
            "counts": ([(n, k, c, T0) for n, k, c in counts], "name string, sampleid string, count bigint, loaded_at timestamp"),
            "qpcr": ([(i, k, r, float(x), 1.0, 1.0, T0) for i, (k, r, x) in enumerate(qpcr)], "reading_id bigint, sampleid string, rep int, cfu double, mass double, dilution double, loaded_at timestamp"),
            "perturbations": ([], "name string, pidx int, subject string, start double, end double, loaded_at timestamp"),
        }
        for n, (r, schema) in rows.items():
            spark.createDataFrame(r, schema).coalesce(1).write.parquet(f"{d}/{n}.parquet")
        return d

    return run


def run(spark, name, d):
    return registry.all_queries()[name](spark, d)


def test_densify_takes_all_times_of_all_subjects(spark, deliver):
    got = {(r["subject"], r["time"]): r["given"] for r in run(spark, "w16_densify", deliver()).collect()}
    given = set(SAMPLES.values())
    assert got == {(s, t): (s, t) in given for s in "AB" for t in (0.0, 0.25, 1.5, 3.0)}


def test_wide_qpcr_has_a_column_for_every_replicate(spark, deliver):
    d = deliver(qpcr=[("A-1", k, 10.0**k) for k in (5, 1, 4, 2, 3)] + [("B-1", 1, 100.0)])
    got = run(spark, "s12_wide_qpcr", d)
    assert got.columns == ["sample_id", *(f"measurement{k}" for k in range(1, 6))]
    assert sorted(map(tuple, got.collect())) == [("A-1", 1, 2, 3, 4, 5), ("B-1", 2, None, None, None, None)]


def test_spearman_has_every_pair(spark, deliver):
    counts = {"T0": [5, 0, 3, 0, 1], "T1": [0, 2, 0, 7, 0], "T2": [0] * 5, "T3": [4, 4, 1, 0, 9], "T4": [3] * 5, **{f"U{k}": [k, 0, 1, 0, 0] for k in range(1, 11)}}
    d = deliver(taxa=[(n, "ACGT", None) for n in counts], counts=[(n, k, c) for n, row in counts.items() for k, c in zip(SAMPLES, row)])
    ranks = pd.DataFrame(list(counts.values())).T.rank()
    got = {(r["a"], r["b"]): r["dist"] for r in run(spark, "j10_spearman", d).collect()}
    assert len(got) == 15 * 14 // 2
    for (a, b), x in got.items():
        if 2 in (a, b):
            assert x == 1
        elif 4 in (a, b):
            assert x is None
        else:
            assert x == pytest.approx((1 - np.corrcoef(ranks[a], ranks[b])[0, 1]) / 2, abs=1e-6)


def test_spearman_blocks_change_nothing(spark, deliver):
    from strandline.operators.design import sparse_spearman
    from strandline.operators.study import Study

    d = deliver(taxa=[(f"T{i}", "ACGT", None) for i in range(7)], counts=[(f"T{i}", k, i * j % 5) for i in range(7) for j, k in enumerate(SAMPLES)])
    s = Study.load(spark, d)
    idx = s.taxa.selectExpr("idx as taxon_idx")
    rows = [sorted((r["a"], r["b"], round(r["dist"], 9)) for r in sparse_spearman(s, idx, k).collect()) for k in (2, 500)]
    assert len(rows[0]) == 21 and rows[0] == rows[1]


def test_spearman_pairs_leave_python_rounded(spark, deliver):
    """Each of the pairs, 1.8 billion of 60,000 taxa, was rounded as a decimal after it had left Python."""
    d = deliver(taxa=[(f"T{i}", "ACGT", None) for i in range(6)], counts=[(f"T{i}", k, (i * j + j * j + i) % 7) for i in range(5) for j, k in enumerate(SAMPLES)])
    from strandline.operators.design import sparse_spearman
    from strandline.operators.study import Study

    s = Study.load(spark, d)
    full = {(r["a"], r["b"]): r["dist"] for r in sparse_spearman(s, s.taxa.selectExpr("idx as taxon_idx"), 2).collect()}
    got = run(spark, "j10_spearman", d)
    assert {(r["a"], r["b"]): r["dist"] for r in got.collect()} == {k: None if x is None else round(x, 6) for k, x in full.items()}
    assert len(full) == 15 and len({*full.values()}) > 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "round(" not in plan[: plan.index("FlatMapCoGroups")]


def test_references_and_distances_among_all_taxa(spark, deliver):
    def lineage(i):
        fam = 0 if i < 30 else 1 + (i - 30) // 4
        return ["K", "P0" if fam < 3 else "P1", f"C{fam // 2}", f"O{fam // 2}", f"F{fam}", f"G{i // 3}", "NA"]

    taxa = [(f"T{i:02}", "ACGT", lineage(i)) for i in range(46)]
    d = deliver(taxa=taxa, counts=[(n, "A-1", 1000 - i) for i, (n, _, _) in enumerate(taxa)])

    def dist(a, b):
        same = next((k for k in range(6) if a[2][k] != b[2][k]), 6)
        return 2.0 * (7 - same)

    want = set()
    for a in taxa:
        near = {b[0]: dist(a, b) for b in taxa if b is not a}
        m = next((m for m in np.arange(1, 2.8, 0.25) if sum(x <= 4 * m for x in near.values()) > 5), 2.75)
        want |= {(a[0], b, x, float(m)) for b, x in near.items() if x <= 4 * m}
    assert {tuple(r) for r in run(spark, "k7_reference_leaves", d).select("item", "ref", "dist", "multiplier").collect()} == want
    assert len({m for *_, m in want}) > 1
    got = {(r["a"], r["b"]): r["dist"] for r in run(spark, "g11_leaf_distances", d).collect()}
    assert got == {(a[0], b[0]): dist(a, b) for a in taxa for b in taxa if a[0] < b[0]}


def test_structural_zeros_mask_grows_with_the_cells(spark, deliver):
    """The mask of a cohort held every taxon in every subject of it."""
    from strandline.operators.study import Study
    from strandline.plans.model_queries import _mask

    d = deliver(taxa=[(f"T{i}", "ACGT", None) for i in range(40)], counts=[("T4", "U-1", 3), ("T4", "U-2", 5), ("T8", "V-1", 2), ("T8", "A-1", 1), ("T3", "A-1", 7), ("T5", "U-1", 1)])
    s = Study.load(spark, d)
    who = {"U-1": ("U1", 2.0), "U-2": ("U1", 12.0), "V-1": ("U2", 4.0), "A-1": ("A", 0.0)}
    s = s.replace(samples=spark.createDataFrame([(k, p, t, 0) for k, (p, t) in who.items()], "sample_id string, subject string, time double, tidx int"))
    own = _mask(s).where("subject is not null")
    assert {tuple(r) for r in own.collect()} == {("T4", "U1", 10.0), ("T8", "U2", 10.0)}
    from strandline.sources.dataset import present_cells

    left = present_cells(s, _mask(s)).collect()
    assert {(r["sample_id"], r["taxon_idx"]) for r in left} == {("U-2", 4), ("A-1", 8), ("U-1", 5)}


@pytest.mark.parametrize("name", ["c7_hamming_neighbours", "g1_otus"])
def test_sequences_are_not_broadcast(spark, deliver, name):
    """Pieces and sequences went to the driver wherever the size estimate was below the limit."""
    from strandline.plans import kernel_queries as KQ

    root = "ACGGTTACGATTACAGGATCCATTGACCAGTTACGGATTACA"
    d = deliver(taxa=[(f"T{i}", root[:i] + "T" + root[i + 1 :], None) for i in range(12)] + [("U", root, None), ("V", root, None)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = KQ.QUERIES[name](spark, d)
        assert got.count() == {"c7_hamming_neighbours": 91, "g1_otus": 14}[name]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_leaves_are_not_shuffled(spark, monkeypatch):
    """Every pair of leaves was shuffled, once for each ancestor that both have, to find its shortest way."""
    from strandline.operators import trees as T

    nodes = T.read_newick(spark, "((a:1,b:2,(c:0.5,(d:0.25,e:4):1):1):0.5,(f:3,(g:0,h:0):0):2,i:1);")
    up = {n["node"]: (n["parent"], n["length"]) for n in nodes.collect()}

    def ways(n):
        out, far = {n: 0.0}, 0.0
        while up[n][0] is not None:
            n, far = up[n][0], far + up[n][1]
            out[n] = far
        return out

    leaves = {n["name"]: ways(n["node"]) for n in nodes.where("leaf").collect()}
    want = {(a, b): min(x[n] + y[n] for n in x if n in y) for a, x in leaves.items() for b, y in leaves.items() if a < b}
    monkeypatch.setattr(T, "BLOCK", 2)
    got = T.leaf_distances(nodes, nodes.where("leaf").select("name"))
    rows = got.collect()
    assert len(rows) == 36 and {(r["a"], r["b"]): r["dist"] for r in rows} == pytest.approx(want)
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    top = tree[: tree.index("Join")]
    assert "Aggregate" not in top
    radius = spark.createDataFrame([("a", 1.5), ("d", 2.0), ("g", 0.5), ("i", 9.0)], "item string, radius double")
    both = {**want, **{(b, a): x for (a, b), x in want.items()}}
    refs = set()
    for item, r in radius.collect():
        m = next((m for m in np.arange(1, 2.8, 0.25) if sum(x <= r * m for (a, _), x in both.items() if a == item) > 2), 2.75)
        refs |= {(a, b, x, float(m)) for (a, b), x in both.items() if a == item and x <= r * m}
    assert {tuple(r) for r in T.widened_references(nodes, radius, 2).collect()} == refs


def test_references_are_counted_before_they_are_listed(spark, monkeypatch):
    """The pairs within each step were kept on disk to be counted."""
    from strandline.operators import trees as T

    kept = []
    monkeypatch.setattr(T, "durable", lambda df: kept.append(df.columns) or df)
    nodes = T.read_newick(spark, "((a:1,b:2):1,(c:1,d:1):3);")
    radius = spark.createDataFrame([("a", 1.5)], "item string, radius double")
    assert [tuple(r) for r in T.widened_references(nodes, radius, 0).collect()] == [("a", "b", 3.0, 2.0)]
    assert kept and not any("ref" in c for c in kept)


def test_neighbours_agree_through_n_and_may_be_short(spark):
    """An N counted as a letter when shared pieces were looked for, and sequences under 22 letters were left out."""
    from strandline.operators import graphs as G

    rng = np.random.default_rng(4)
    seqs = []
    for size, many in ((0, 2), (3, 4), (12, 8), (21, 10), (22, 6), (44, 30), (61, 30)):
        root = rng.choice(list("ACGT"), size)
        for i in range(many):
            x = root.copy()
            x[rng.random(size) < 0.2 * rng.random()] = "T"
            x[rng.random(size) < [0, 0.02, 0.1, 0.3, 0.9, 1][i % 6]] = "N"
            seqs.append("".join(x))
    rows = spark.createDataFrame(list(enumerate(seqs)), "id bigint, seq string")
    for most in (2, 10):
        dist = {(i, j): sum(p != q and "N" not in (p, q) for p, q in zip(a, b)) for i, a in enumerate(seqs) for j, b in enumerate(seqs) if i < j and len(a) == len(b)}
        want = {(*k, x) for k, x in dist.items() if x <= most}
        got = [tuple(r) for r in G.hamming_neighbours(rows, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert 0 < len(want) and (most == 10 or len(want) < len(dist))


def test_noise_is_calibrated_on_all_subjects_and_taxa(spark, deliver, monkeypatch):
    """Only subjects of ten samples or more and the few steadily abundant taxa of theirs were taken."""
    from strandline.plans import report_queries as RQ

    seen = []
    monkeypatch.setattr(RQ, "calibrate_noise", lambda spark, reads, **kw: seen.extend(reads) or spark.createDataFrame([(0, "a0", 60, 1.0)], "chain bigint, var string, gibbs bigint, value double"))
    d = deliver(taxa=[(f"T{i}", "ACGT", None) for i in range(4)], counts=[("T0", "A-1", 900), ("T1", "A-1", 1), ("T1", "A-3", 5), ("T3", "B-1", 2), ("T2", "B-2", 7)])
    run(spark, "b16_calibrate_study", d).collect()
    assert [r.tolist() for r in seen] == [[[900, 1], [0, 5]], [[0, 2], [7, 0]]]


def test_spearman_shuffles_no_taxon_for_every_block(spark, deliver):
    """The moments of a block of taxa were shuffled once for each other block: quadratic, and full disks at size."""
    from strandline.operators.design import sparse_spearman
    from strandline.operators.study import Study

    d = deliver(taxa=[(f"T{i}", "ACGT", None) for i in range(9)], counts=[(f"T{i}", k, (i * j + 1) % 4) for i in range(8) for j, k in enumerate(SAMPLES)])
    s = Study.load(spark, d)
    got = sparse_spearman(s, s.taxa.selectExpr("idx as taxon_idx"), 2)
    assert got.count() == 36
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("FlatMapCoGroups") :].split("\n", 1)[1]
    assert "s1" not in left and "xy" in left
