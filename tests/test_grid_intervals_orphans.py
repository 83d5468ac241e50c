import datetime as dt
import math
import random

import numpy as np
import pytest

from strandline.operators.intervals import dyadic_blocks, merge_blocks, periods_and_gaps, study_intervals
from strandline.operators.orphans import study_orphans
from strandline.operators.regular_grid import regular_grid

T = dt.datetime(2020, 1, 1)


# ---------------------------------------------------------------- grid


@pytest.mark.parametrize("block", [4, 1024])
@pytest.mark.parametrize("step,limit", [(1.0, None), (0.5, 3.0)])
def test_grid_against_brute_force(spark, block, step, limit):
    rnd = random.Random(5)
    rows = [(s, round(rnd.uniform(-5, 40), 2), rnd.choice([None, rnd.gauss(0, 1)])) for s in ("A", "B") for _ in range(12)]
    rows += [rows[0], ("A", rows[0][1], 9.0), ("C", 2.5, 1.0), (None, 1.0, 1.0), ("D", None, 1.0), ("D", math.nan, 1.0), ("A", math.inf, 1.0)]
    df = spark.createDataFrame([(s, t, v, "x") for s, t, v in rows], "source string, t double, value double, cell string")
    got = {(r["source"], r["cell"]): r for r in regular_grid(df, step, limit, block).collect()}
    want = set()
    for s in ("A", "B", "C"):
        mine = [(t, v) for q, t, v in rows if q == s and t is not None and math.isfinite(t)]
        cells = {math.floor(t / step) for t, _ in mine}
        for c in range(min(cells), max(cells) + 1):
            want.add((s, c))
            r = got[s, c]
            inside = [v for t, v in mine if math.floor(t / step) == c]
            assert r["n_readings"] == len(inside)
            if inside:
                known = [v for v in inside if v is not None]
                assert r["state"] == "observed" and (r["value"] == pytest.approx(np.mean(known)) if known else r["value"] is None)
                continue
            tb, ta = max(t for t, _ in mine if math.floor(t / step) < c), min(t for t, _ in mine if math.floor(t / step) > c)
            assert (r["t_before"], r["t_after"]) == (tb, ta)
            vb, va = ([v for t, v in mine if t == x and v is not None] for x in (tb, ta))
            if vb and va and (limit is None or ta - tb <= limit):
                b, a = np.mean(vb), np.mean(va)
                assert r["state"] == "filled" and r["value"] == pytest.approx(b + (a - b) * (c * step - tb) / (ta - tb))
            else:
                assert r["state"] == "gap" and r["value"] is None
    assert set(got) == want


@pytest.mark.parametrize("wrong", [1e15, 1e300, -1e300, 150.0])
def test_grid_names_a_source_that_is_too_long(spark, wrong):
    df = spark.createDataFrame([("S1", 0.0, 1.0), ("S1", wrong, 1.0), ("S2", 0.0, 1.0), ("S2", 99.0, 1.0)], "source string, t double, value double")
    with pytest.raises(Exception, match="most_cells allows in source S1"):
        regular_grid(df, most_cells=100).collect()
    assert regular_grid(df.where("source = 'S2'"), most_cells=100).count() == 100


def test_grid_empty(spark):
    assert regular_grid(spark.createDataFrame([], "source string, t double, value double")).count() == 0


# ---------------------------------------------------------------- intervals


def test_dyadic_blocks_cover_exactly():
    rnd = random.Random(1)
    s = np.array([rnd.randint(-3000, 30000) for _ in range(200)])
    e = s + np.array([rnd.randint(1, 40000) for _ in range(200)])
    row, lv, ix = dyadic_blocks(s, e)
    for i in range(200):
        parts = sorted((int(x) << int(v), (int(x) + 1) << int(v)) for v, x in zip(lv[row == i], ix[row == i]))
        assert parts[0][0] == s[i] and parts[-1][1] == e[i] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_merge_blocks():
    got = merge_blocks(np.array([0, 0, 1, 3, 0]), np.array([4, 5, 3, 0, 20]))
    assert [x.tolist() for x in got] == [[0, 20], [8, 21]]
    assert [len(x) for x in merge_blocks(np.array([], int), np.array([], int))] == [0, 0]
    got = merge_blocks(np.array([0, 0, 1, 2]), np.array([0, 1, 1, 1]))  # siblings merge above the highest level given
    assert [x.tolist() for x in got] == [[0], [8]]


def islands(rows):
    out = set()
    for key in {r[0] for r in rows}:
        xs = sorted((s, e) for k, s, e in rows if k == key)
        cur, per = list(xs[0]), []
        for s, e in xs[1:]:
            if s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                per.append(tuple(cur))
                cur = [s, e]
        per.append(tuple(cur))
        out |= {("period", key, *p) for p in per} | {("gap", key, a[1], b[0]) for a, b in zip(per, per[1:])}
    return out


def test_periods_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), s := rnd.randint(-9000, 60000), s + rnd.choice([1, 5, 300, 8192, 20000])) for _ in range(60)]
    rows += [("c", 0, 8192), ("c", 8192, 16384), ("c", 16384, 16385), ("d", 100, 200), ("d", 100, 200), ("d", 200, 210), ("d", 150, 160)]
    bad = [("e", 5, 5), ("e", 9, 3), ("e", None, 3), ("e", 3, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "k string, s bigint, e bigint, kind string")
    got = {tuple(r) for r in periods_and_gaps(df.drop("kind").withColumnRenamed("k", "key"), ["key"], "s", "e").select("kind", "key", "start", "end").collect()}
    assert got == islands(rows)
    assert periods_and_gaps(df.limit(0), ["k"], "s", "e").count() == 0


def test_periods_of_any_length(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), s := rnd.randint(-(1 << 40), 1 << 40) >> rnd.randint(0, 40), s + max(1, rnd.randint(1, 1 << 38) >> rnd.randint(0, 38))) for _ in range(150)]
    rows += [("c", -(1 << 62), 1 << 62), ("c", 5, 6), ("d", 0, 1 << 61), ("d", 1 << 61, (1 << 61) + 3), ("d", (1 << 61) + 8200, (1 << 61) + 8201)]
    rows += [("e", 0, 8192), ("e", 8192, 32768), ("e", 8191, 8193), ("e", 40000, 40001), (None, 0, 1 << 30), (None, 77, 78)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    got = {tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e").select("kind", "k", "start", "end").collect()}
    assert got == islands(rows)
    with pytest.raises(Exception, match="2\\*\\*62"):
        periods_and_gaps(spark.createDataFrame([("a", 0, (1 << 62) + 1)], "k string, s bigint, e bigint"), ["k"], "s", "e").collect()


def test_study_intervals_drop_bad_rows(spark):
    rows = [(" A ", "x1", 0.0, 1.0), ("a", "X1 ", 1.0, 2.0), (None, "x1", 0.0, 1.0), ("x", None, 0.0, 1.0), ("x", "s", math.nan, 1.0), ("x", "s", 0.0, math.inf), ("x", "s", 2.0, 1.0)]
    df = study_intervals(spark.createDataFrame(rows, "name string, subject string, start double, end double"))
    got = [tuple(r) for r in periods_and_gaps(df, ["subject", "name"], "start_hour", "end_hour").collect()]
    assert got == [("period", "X1", "a", 0, 48)]


# ---------------------------------------------------------------- orphans


def test_orphans(spark):
    day = dt.timedelta(days=1)
    m = spark.createDataFrame(
        [("s1", "u1", T, None), (" S1", "u1", T + 5 * day, None), ("s2", "u2", T + 40 * day, None), ("s3", None, T, T + 10 * day), ("s4", "u4", T, T + 10 * day), ("s4", "u4", T, T + 50 * day), (None, "u5", None, None)],
        "sampleid string, subject string, loaded_at timestamp, withdrawn_at timestamp",
    )
    q = spark.createDataFrame([("s1 ", T), ("s2", T), ("s2", T + 60 * day), ("s3", T + day), ("s3", T + 11 * day), ("s4", T + 20 * day), ("s4", T + 50 * day), ("nope", T), ("nope", T), (None, T), ("nope", None), (" ", T)], "sampleid string, loaded_at timestamp")
    c = spark.createDataFrame([("S9", T, 3)], "sampleid string, loaded_at timestamp, n int")
    p = spark.createDataFrame([("u1", T - day), ("u9", T), ("U5 ", T)], "subject string, loaded_at timestamp")
    got = sorted((r["ref_table"], r["ref_key"], r["period"] or "", r["kind"], r["n_rows"]) for r in study_orphans(m, q, c, p).collect())
    assert got == sorted(
        [("qpcr", "S2", "2020-01", "late", 1), ("qpcr", "S3", "2020-01", "withdrawn", 2), ("qpcr", "S4", "2020-02", "withdrawn", 1), ("qpcr", "NOPE", "2020-01", "missing", 2), ("qpcr", "NOPE", "", "missing", 1), ("counts", "S9", "2020-01", "missing", 1), ("perturbations", "U1", "2019-12", "late", 1), ("perturbations", "U9", "2020-01", "missing", 1)]
    )
    assert study_orphans(m, q.limit(0), c.limit(0), p.limit(0)).count() == 0
    assert {r["kind"] for r in study_orphans(m.limit(0), q, c, p).collect()} == {"missing"}
