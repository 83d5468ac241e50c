import random

import numpy as np
import pytest

from strandline.llm import near_dup as N
from strandline.operators.graphs import connected_groups


def norm(s):
    return "".join(c for c in s if not c.isspace() and c != "-").upper().replace("U", "T")


def brute(rows, t=0.7, width=10):
    grams = [(i, {x[k : k + width] for k in range(len(x) - width + 1)}) for i, s in rows if i is not None and s is not None and len(x := norm(s)) >= width]
    return {(min(i, j), max(i, j)) for a, (i, x) in enumerate(grams) for j, y in grams[:a] if i != j and len(x & y) >= t * len(x | y)}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for f in range(25):
        root = [rnd.choice("ACGT") for _ in range(rnd.randint(10, 160))]
        for _ in range(rnd.randint(1, 7)):
            s = root[:]
            for _ in range(rnd.randint(0, 6)):
                k = rnd.randrange(len(s))
                s[k : k + rnd.randint(0, 1)] = rnd.choice(["A", "C", "GT", ""])
            text = "".join(s) + "CTCCGGCGCCCATGCTTTGGTT" * (f % 2)  # a stretch that half of all share
            out.append((len(out), rnd.choice([text, text.lower(), " ".join(text), text.replace("T", "U"), text[:5] + "-" + text[5:]])))
    out += [(500, None), (501, ""), (502, "NA"), (503, "ACGTACGTA"), (504, "ACGTACGTAC"), (505, "acgu acgt-ac"), (506, "A" * 5000), (507, "A" * 4000), (None, "ACGTACGTAC"), (0, out[0][1])]
    return out


def test_pairs_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "HOT_POSTINGS", 3)  # every longer list is split
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in rows], "idx int, sequence string, rep string, lvl int")
    got = [(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


@pytest.mark.parametrize("classes,rare,shared,check", [(2, 1, 1, 1.0), (5, 2, 3, 30.0), (12, 0, 6, 30.0), (12, 1000, 6, 0.0), (12, 1000, 6, 1e6), (20, 4, 20, 5.0)])
def test_levels_only_steer_the_cost(spark, rows, monkeypatch, classes, rare, shared, check):
    monkeypatch.setattr(N, "CHECK_COST", check)
    monkeypatch.setattr(N, "CLASSES", classes)
    monkeypatch.setattr(N, "SHARED", shared)
    monkeypatch.setattr(N, "RARE", rare)
    df = spark.createDataFrame(rows, "idx int, sequence string")
    assert {tuple(r) for r in N.near_duplicate_pairs(df, threshold=0.8, width=6).collect()} == brute(rows, 0.8, 6)
    assert {tuple(r) for r in N.near_duplicate_pairs(df).collect()} == brute(rows)


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "idx int, sequence string")
    pairs = brute(rows)
    grp = {i: i for i, s in rows if i is not None and s is not None and len(norm(s)) >= 10}
    for _ in grp:
        for a, b in pairs:
            grp[a] = grp[b] = min(grp[a], grp[b])
    got = N.near_duplicate_groups(df).collect()
    assert {r["id"]: r["grp"] for r in got} == grp
    assert {r["id"]: r["copies"] for r in got}[504] == 2


def test_empty(spark):
    df = spark.createDataFrame([], "idx int, sequence string")
    assert N.near_duplicate_pairs(df).count() == 0
    assert N.near_duplicate_groups(df).count() == 0


def test_components_of_a_long_chain(spark):
    nodes = spark.range(300).toDF("node")
    links = spark.createDataFrame([(i, i + 1) for i in range(199)] + [(250, 260), (260, 250), (270, 270)], "a bigint, b bigint")
    got = {r["node"]: r["grp"] for r in connected_groups(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(200)) and got[260] == 250 and got[270] == 270 and len(got) == 300


def test_many_copies_are_a_star(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND_COPIES", 20)
    text = "ACGGTTACGATTACAGGATC" * 3
    rows = [(i, text) for i in range(100)] + [(100, text + "G"), (101, text + "G")]
    got = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, "idx int, sequence string")).collect()}
    assert got == {(0, i) for i in range(1, 102)} | {(100, 101)}


def test_levels_follow_the_cost():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ACGT") for _ in range(200)) for _ in range(4)]
    some = np.where(np.random.default_rng(0).random(N.FREQ_SLOTS) < 0.29, 1, 2)
    quiet = N.Prefixes(some, 10**6, 0.7, 10).keys(np.arange(4), texts)
    busy = N.Prefixes(np.full(N.FREQ_SLOTS, 500), 10**6, 0.7, 10).keys(np.arange(4), texts)
    assert (quiet[4] > 0).all() and (quiet[4] > 1).any()  # few frequent shingles: a longer prefix of single ones, several to be shared
    assert (busy[4] == 0).all()  # many: pairs
    assert not len(N.Prefixes(np.ones(N.FREQ_SLOTS, np.int64), 10**6, 0.7, 10).keys(np.arange(4), texts)[0])


def test_no_join_is_broadcast(spark, rows):
    df = spark.createDataFrame(rows, "idx int, sequence string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for got in (N.near_duplicate_pairs(df), N.similar_classes(df), N.near_duplicate_groups(df)):
            got.collect()
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_move_once_and_packed(spark, rows):
    """Each key's posting used to be written to a checkpoint and shuffled twice, a row a key."""
    df = spark.createDataFrame(rows, "idx int, sequence string")
    plan = N.similar_classes(df)._jdf.queryExecution().toString()
    assert "range#" in plan and "keys#" in plan and "tok#" not in plan
    picker = N.Prefixes(np.full(N.FREQ_SLOTS, 2), 10**6, 0.7, 10)
    texts = [norm(s) for i, s in rows[:40]]
    picker.ranges = 7
    key, f, rep, n, level, entry = picker.keys(np.arange(40), texts)
    got, packs = picker.packed(np.arange(40), texts)
    tok, back, note = (np.concatenate(c) for c in zip(*map(N._unpacked, packs)))
    assert len(got) == 7 and len(tok) == len(key) and (np.diff(tok) >= 0).all()
    want = zip(rep.tolist(), n.tolist(), level.tolist(), entry.tolist())
    assert sorted(zip(back.tolist(), (note >> 11).tolist(), (note & 31).tolist(), (note >> 5 & 31).tolist())) == sorted(want)


def test_classes_and_members_hold_every_pair(spark, rows):
    df = spark.createDataFrame(rows, "idx int, sequence string")
    links = {(r["rep_a"], r["rep_b"]) for r in N.similar_classes(df).collect()}
    rep = {r["id"]: r["rep"] for r in N.near_duplicate_groups(df).collect()}
    want = {(min(rep[i], rep[j]), max(rep[i], rep[j])) for i, j in brute(rows) if rep[i] != rep[j]}
    assert links == want
