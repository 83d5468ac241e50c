import random
import re

import numpy as np
import pytest

from strandline.llm import leakage as L
from strandline.llm.textscan import plain

WORD = re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall(plain(t).lower())


def brute(docs, items, run=10):
    out = set()
    for d, t in docs:
        if t is None:
            continue
        w = words(t)
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        out |= {(d, i) for i, s in items if s is not None for v in [words(s)] for k in range(len(v) - run + 1) if tuple(v[k : k + run]) in grams}
    return out


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(60)] + ["Äpfel", "naïve", "X9"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 40))) + ".") for i in range(20)]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "too short"), (24, items[1][1])]
    docs = []
    for d in range(80):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if d % 2:
            src = words(items[rnd.randrange(20)][1])
            k = rnd.randrange(len(src))
            piece = src[k : k + rnd.randint(8, 20)]
            piece = [p.upper() if rnd.random() < 0.2 else p for p in piece]
            at = rnd.randint(0, len(w))
            w[at:at] = piece
        sep = rnd.choice([" ", ", ", "<b>", " </i>\n", "_"])
        docs.append((d, sep.join(w)))
    docs += [(100, None), (101, ""), (102, "​"), (103, words(items[2][1])[0]), (104, items[3][1][:3] + "­" + items[3][1][3:]), (3, docs[3][1])]
    docs.append((105, "pad " * 30_000 + items[5][1] + " pad" * 30_000))
    return docs, items


def test_exact_leaks(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(L, "PART", 20_000)  # long texts are cut
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = L.leaked_items(d, q).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["dist"] == 0} == brute(docs, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def near(docs, items, run=10):
    """{(doc, item): (dist, runs)} with up to one word edited, from sets of stretches."""
    cut = lambda t, k: t[:k] + t[k + 1 :]
    out = {}
    for d, t in docs:
        w = words(t) if t is not None else []
        grams = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in (run - 1, run, run + 1)}
        swapped = {(k, cut(g, k)) for g in grams[run] for k in range(run)}
        longer = {cut(g, k) for g in grams[run + 1] for k in range(run + 1)}
        for i, s in items:
            v = words(s) if s is not None else []
            for k in range(len(v) - run + 1):
                p = tuple(v[k : k + run])
                if p in grams[run]:
                    dist = 0
                elif p in longer or any(cut(p, j) in grams[run - 1] or (j, cut(p, j)) in swapped for j in range(run)):
                    dist = 1
                else:
                    continue
                least, runs = out.get((d, i), (1, 0))
                out[d, i] = (min(least, dist), runs + 1)
    return out


@pytest.mark.parametrize("most", [7, 10_000])
def test_any_number_of_items_and_random_edits(spark, tables, monkeypatch, most):
    """Whether the index is broadcast or joined: every leak with up to one edited word, and no other."""
    monkeypatch.setattr(L, "INDEX_ITEMS", most)
    docs, items = tables
    docs = [x for x in docs if x[0] not in (3, 105)]
    rnd = random.Random(2)
    for d in range(200, 300):
        w = words(items[rnd.randrange(20)][1])
        for _ in range(rnd.randint(1, 3)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["edit"], ["w1"]])
        docs.append((d, " ".join(["pre"] * rnd.randint(0, 2) + w + ["post"] * rnd.randint(0, 2))))
    want = near(docs, items)
    assert sum(d for d, _ in want.values()) > 10
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["dist"], r["runs"]) for r in got.collect()} == want


def test_one_edited_word_is_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item.replace("gamma", "gamba")), (2, item.replace("gamma ", "")), (3, item.replace("gamma", "gamma extra")), (4, item.replace("gamma", "x").replace("theta", "y")), (5, item)]
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert {r["doc_id"]: r["dist"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 5: 0}


@pytest.mark.parametrize("most", [0, 10_000])
def test_empty(spark, monkeypatch, most):
    monkeypatch.setattr(L, "INDEX_ITEMS", most)
    d, q = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert L.leaked_items(d.limit(0), q).count() == L.leaked_items(d, q.limit(0)).count() == L.leaked_items(d, q).count() == 0


def test_myers_against_table():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        m, n = rnd.integers(1, 11), rnd.integers(1, 14)
        p, t = rnd.integers(0, 3, m).astype(np.uint64), rnd.integers(0, 3, n).astype(np.uint64)
        row = np.zeros(n + 1, int)
        for i in range(m):
            new = [i + 1]
            for j in range(n):
                new.append(min(row[j] + (p[i] != t[j]), row[j + 1] + 1, new[j] + 1))
            row = np.array(new)
        assert L.myers(p[None], t[None])[0] == row.min()
