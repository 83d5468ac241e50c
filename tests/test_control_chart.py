import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.operators.control_chart import chart_suspects, implausible_readings, stuck_values
from strandline.operators.ordered import group_median, with_blocks

Q = "reading_id bigint, sampleid string, rep int, cfu double, mass double, dilution double, loaded_at timestamp, subject string, time double"
M = "sampleid string, subject string, time double, loaded_at timestamp, withdrawn_at timestamp, mass double"
T = dt.datetime(2020, 1, 1)


def brute(readings, times):
    """(impossible, spike, stuck) ids, straight from the definition."""
    imp, spike, stuck = set(), set(), set()
    by = {}
    for i, s, rep, cfu, mass, dil in readings:
        if not math.isfinite(cfu) or cfu < 0 or mass <= 0 or cfu * dil / mass > 1e14:
            imp.add(i)
        if math.isfinite(cfu) and cfu > 0 and mass > 0:
            by.setdefault(s[0], []).append((math.log10(cfu * dil / mass), i))
    for xs in by.values():
        if len(xs) >= 10:
            m = statistics.median(x for x, _ in xs)
            d = statistics.median(abs(x - m) for x, _ in xs)
            spike |= {i for x, i in xs if abs(x - m) > 10 * d}
    line = {}
    for i, s, rep, cfu, mass, dil in readings:
        if times[s] is not None:
            line.setdefault((s[0], rep), []).append((times[s], s, i, cfu))
    for xs in line.values():
        xs.sort()
        run = []
        for x in [*xs, (0, "", -1, None)]:
            if run and x[3] == run[-1][3] and math.isfinite(x[3]) and x[3] > 0:
                run.append(x)
                continue
            if len(run) >= 5:
                stuck |= {r[2] for r in run}
            run = [x]
    return imp, spike, stuck


@pytest.mark.parametrize("block", [7, 50_000])
def test_against_brute_force(spark, block):
    rnd = random.Random(3)
    times, readings = {}, []
    for subj in "ABC":
        for k in range(60 if subj == "A" else 12):
            s = f"{subj}-{k:03d}"
            times[s] = None if rnd.random() < 0.1 else rnd.choice([float(k), float(k) / 2])
            for rep in (1, 2):
                cfu = rnd.choice([5.0, 5.0, 5.0, 7.0, math.exp(rnd.gauss(3, 0.3))]) if rnd.random() < 0.9 else rnd.choice([-1.0, 0.0, 1e30, math.nan, math.inf, 1e9])
                readings.append((len(readings), s, rep, cfu, rnd.choice([1.0, 1.0, 1.0, 0.0]), 10.0))
    q = spark.createDataFrame([(*r, T, "clash", 1.0) for r in readings] + [(*readings[0], T - dt.timedelta(1), "clash", 1.0)], Q)
    m = spark.createDataFrame([(s.lower() + " ", s[0], t, T, None, 1.0) for s, t in times.items()], M)
    got = implausible_readings(q, m, block_rows=block).collect()
    imp, spike, stuck = brute(readings, times)
    assert {r["id"] for r in got if r["impossible"]} == imp
    assert {r["id"] for r in got if r["spike"]} == spike
    assert {r["id"] for r in got if r["stuck"]} == stuck
    assert len(got) == len(imp | spike | stuck)


def test_nulls_and_empty(spark):
    m = spark.createDataFrame([("s1", None, 1.0, T, None, 1.0), ("s2", "B", 1.0, T, T, 1.0), (None, "C", 1.0, None, None, None), ("s3", "D", math.nan, None, None, 1.0)], M)
    q = spark.createDataFrame([(1, "s1", 1, -5.0, 1.0, 1.0, T, "", 0.0), (2, "s2", 1, -5.0, 1.0, 1.0, T, "", 0.0), (3, None, 1, -5.0, 1.0, 1.0, T, "", 0.0), (4, "s3", None, -5.0, None, None, None, "", 0.0), (5, "s3", 1, None, 1.0, 1.0, T, "", 0.0), (None, "s3", 1, -5.0, 1.0, 1.0, T, "", 0.0)], Q)
    assert [r["id"] for r in implausible_readings(q, m).collect()] == [4]  # no subject, withdrawn, no sample, no cfu: not judged
    assert implausible_readings(q.limit(0), m).count() == 0
    assert implausible_readings(q, m.limit(0)).count() == 0


def test_chart_follows_drift_and_never_misses_far_values(spark):
    rnd = random.Random(1)
    rows = [(i, "s", float(i), rnd.gauss(0, 1) + (60.0 if i % 97 == 5 else 0.0)) for i in range(2000)]
    got = {r["id"] for r in chart_suspects(spark.createDataFrame(rows, "id bigint, source string, time double, x double"), block_rows=300).collect()}
    assert {i for i in range(2000) if i % 97 == 5} <= got
    assert len(got) < 100


def test_stuck_across_blocks(spark):
    rows = [(i, "s", 1, float(i), f"t{i:04d}", 2.0) for i in range(500)]
    got = stuck_values(spark.createDataFrame(rows, "id bigint, source string, series int, time double, tie string, raw double"), 5, 20).collect()
    assert {r["run_length"] for r in got} == {500} and len(got) == 500


def test_median_and_blocks(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([1.5, rnd.gauss(0, 3)])) for k in ("a", "b", None) for _ in range(rnd.randint(1, 400))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in group_median(df, ["k"], "v", "m").collect()}
    for k in ("a", "b", None):
        assert got[k] == pytest.approx(statistics.median(v for q, v in rows if q == k))
    blocks = with_blocks(df, ["k"], "v", 50)
    assert blocks.count() == len(rows)
    # blocks rise with the order
    per = blocks.where("k = 'a'").groupBy("blk").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("blk").collect()
    assert all(x["hi"] <= y["lo"] for x, y in zip(per, per[1:]))
