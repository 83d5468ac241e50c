import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.functions import distributions as D
from strandline.inference.data import Observations, Series
from strandline.inference.gibbs import Chain, Config
from strandline.inference.run import infer, resumed
from strandline.operators import kernels as K
from strandline.operators import posterior as P
from strandline.operators import relational as R
from strandline.operators import sequences as Q
from strandline.operators import trees as T
from strandline.sources import tables as S
from strandline.streaming.monitor import event_windows, read_trace_stream, watch_trace

FILES = {
    "metadata": "sampleID\tsubject\ttime\ns1\tA\t0\ns2\tA\t1\ns3\tA\t2.5\ns4\tB\t0\ns5\tB\t1\n",
    "taxonomy": "Name\tSequence\tKingdom\tPhylum\nT1\tACGT\tBacteria\tFirmicutes\nT2\tACGA\tBacteria\tBacteroidetes\nT3\tNCGA\tBacteria\tFirmicutes\n",
    "counts": "name\ts1\ts2\ts3\ts4\ts5\nT1\t10\t20\t0\t5\t5\nT2\t30\t20\t40\t15\t0\nT3\t0\t0\t10\t0\t15\n",
    "qpcr": "sampleID\tmeasurement1\tmeasurement2\tmeasurement3\ns1\t100\t400\t\ns2\t200\t\t\ns3\t50\t50\t50\ns4\t10\t1000\t\ns5\t300\t300\t\n",
    "perturbations": "name\tstart\tend\tsubject\nP1\t0\t1\tA\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("study")
    for n, t in FILES.items():
        (d / f"{n}.tsv").write_text(t)
    return str(d)


@pytest.fixture(scope="module")
def study(spark, folder):
    return S.read_study(spark, folder)


def test_hand_checked_instance(study):
    ab = {(r["subject"], r["time"], r["taxon"]): r for r in study.abundance.collect()}
    assert ab["A", 0.0, "T1"]["rel"] == 0.25 and ab["A", 0.0, "T1"]["abs"] == pytest.approx(50)
    assert ab["B", 0.0, "T1"]["biomass"] == pytest.approx(100)
    assert {r["time"] for r in R.common_times(study.samples).collect()} == {0.0, 1.0}
    assert [r["sample_id"] for r in R.interval_join(study.samples, study.perts).where("pert is not null").collect()] == ["s2"]
    assert {r["taxon"] for r in Q.consistent_taxa(study, "raw", 5, 2, 1).collect()} == {"T1", "T2"}
    assert {r["taxon"] for r in Q.consistent_taxa(study, "raw", 5, 2, 2).collect()} == {"T1"}
    mean = {(r["taxon_idx"], r["time"]): r["value"] for r in R.aggregate_over_subjects(study, "raw", "mean").collect()}
    assert mean[0, 0.0] == 7.5
    fam = R.cluster_by_level(study, "raw", "phylum").where("subject = 'A' and time = 2.5 and phylum = 'Firmicutes'").first()
    assert fam["value"] == 10
    y = Q.log_growth(study).where("subject = 'A' and taxon_idx = 1 and time = 0").first()["y"]
    assert y == pytest.approx(np.log(100 / 150))


def test_round_trips(spark, study, folder, tmp_path):
    S.save_study(study, str(tmp_path / "p"))
    again = S.load_study(spark, str(tmp_path / "p"))
    S.write_study_tsv(again, str(tmp_path / "t"))
    third = S.read_study(spark, str(tmp_path / "t"))
    for n in ("samples", "reads", "qpcr", "perts"):
        cols = [c for c in getattr(study, n).columns if c not in ("reading_id", "pidx", "rep")]
        assert sorted(map(tuple, getattr(study, n).select(*cols).collect())) == sorted(map(tuple, getattr(third, n).select(*cols).collect()))
    with open(f"{folder}/bad.tsv", "w") as f:
        f.write("T1\t5\n")
    with pytest.raises(S.BadStudy):
        S.read_initial_conditions(spark, f"{folder}/bad.tsv", study.taxa)


def test_unknown_sample_is_refused(spark, tmp_path):
    for n, t in FILES.items():
        (tmp_path / f"{n}.tsv").write_text(t.replace("s5", "s9") if n == "qpcr" else t)
    with pytest.raises(S.BadStudy):
        S.read_study(spark, str(tmp_path))


def test_agglomerate_and_loess():
    d = np.array([[0, 1, 5, 6], [1, 0, 5, 6], [5, 5, 0, 2], [6, 6, 2, 0]], float)
    assert K.agglomerate(d, "average", n_clusters=2).tolist() == [0, 0, 1, 1]
    assert K.agglomerate(d, "complete", threshold=1.5).tolist() == [0, 0, 1, 2]
    x = np.array([0.0, 1, 2, 4, 5, 9])
    assert np.allclose(K.loess(x, 2 * x + 1, 4), 2 * x + 1)
    assert K.loess(np.array([1.0]), np.array([3.0]), 6).tolist() == [3.0]


def test_simulation_keeps_zero_and_perturbs():
    g, a = np.array([[0.5, 0.5]]), np.array([[[-0.1, 0.0], [0.0, -0.1]]])
    x = K.simulate_batch(np.array([1.0, 0.0]), g, a, 0.1, 50.0, keep=[0, 500])[0]
    assert x[1, 1] == 0 and x[1, 0] == pytest.approx(5.0, rel=1e-3)
    p = K.simulate_batch(np.array([1.0, 1.0]), g, a, 0.1, 1.0, perturbations=[K.Perturbation(0.0, 1.0, np.array([-1.0, 0.0]))])[0]
    assert p[-1, 0] < 1 < p[-1, 1]


def test_distributions():
    import math

    assert D.lgamma(np.array([0.5, 3.3, 171.0])) == pytest.approx([math.lgamma(v) for v in (0.5, 3.3, 171.0)])
    assert D.normal_quantile(np.array([0.025, 0.5])) == pytest.approx([-1.959964, 0], abs=1e-5)
    rng = D.generator(1, "t")
    z = D.sample_truncnormal(rng, 0.0, 1.0, 9.0, np.inf, (200,))
    assert (z >= 9).all() and z.mean() < 9.3
    z = D.sample_truncnormal(rng, 0.0, 1.0, -1.0, 1.0, (4000,))
    assert abs(z.mean()) < 0.05 and np.abs(z).max() <= 1
    k = D.sample_negbin(rng, 50.0, 0.2, (20000,))
    assert k.mean() == pytest.approx(50, rel=0.03) and k.var() == pytest.approx(50 + 0.2 * 2500, rel=0.1)
    k = np.arange(400)
    assert np.exp(D.negbin_logpmf(k, 20.0, 0.3)).sum() == pytest.approx(1, abs=1e-6)


def _observations(n=5):
    rng = D.generator(2, "o")
    series = []
    for j in range(2):
        t = np.arange(0, 16, 2.0)
        x = np.exp(rng.normal(0, 0.3, (len(t), n)))
        reads, q = K.measure(x, 1e-10, 0.01, 0.05, 5000, rng)
        series.append(Series(f"s{j}", t, reads, list(np.log(q)), np.ones((len(t) - 1, 1)) * (np.arange(len(t) - 1)[:, None] == 3)))
    return Observations([f"t{i}" for i in range(n)], ["P"], series)


def test_chain_resumes_exactly(spark, tmp_path):
    obs, cfg = _observations(), Config(burnin=4, n_samples=12, checkpoint=6)
    whole = infer(spark, obs, cfg, 2).where("var <> 'state'").toPandas()
    half = infer(spark, obs, Config(burnin=4, n_samples=6, checkpoint=6), 2)
    half.write.parquet(str(tmp_path / "half"))
    both = resumed(spark, obs, cfg, spark.read.parquet(str(tmp_path / "half")), 12, 2).where("var <> 'state'").toPandas()
    key = ["chain", "var", "gibbs", "i", "j"]
    a, b = (x.sort_values(key)[[*key, "value"]].reset_index(drop=True) for x in (whole, both))
    assert a.equals(b)
    assert set(whole["chain"]) == {0, 1} and np.isfinite(whole["value"]).all()


def test_marginal_matches_dense_formula():
    c = Chain(_observations(), Config(), 0)
    rng = D.generator(3, "m")
    f, y = rng.normal(size=(30, 4)), rng.normal(size=30)
    mean, var = rng.normal(size=4), np.array([0.5, 1.0, 2.0, 3.0])

    def full(idx):
        cov = np.eye(30) + f[:, idx] @ np.diag(var[idx]) @ f[:, idx].T
        return D.mvn_logpdf(y, f[:, idx] @ mean[idx], cov)

    for idx in ([0], [1, 3], [0, 1, 2, 3]):
        got = c.marginal(f.T @ f, f.T @ y, mean, var, np.array(idx))
        assert got == pytest.approx(full(idx) - full([]), abs=1e-8)


def test_trees(spark):
    nodes = T.read_newick(spark, "((a:1,b:2)x:1,('c d':3,e:1):2,f:10)root;")
    d = {(r["a"], r["b"]): r["dist"] for r in T.leaf_distances(nodes, nodes.where("leaf").select("name")).collect()}
    assert d["a", "b"] == 3 and d["a", "c d"] == 7 and d["c d", "e"] == 4 and len(d) == 10
    grp = {r["leaf"]: r["grp"] for r in T.coarsen(nodes, 1.0).collect()}
    assert grp["a"] == grp["b"] != grp["c d"] == grp["e"]
    dist = spark.createDataFrame([("q", f"r{k}", 0.5 + k / 4) for k in range(10)], "item string, ref string, dist double")
    got = T.reference_leaves(dist, spark.createDataFrame([("q", 1.0)], "item string, radius double")).collect()
    assert {r["multiplier"] for r in got} == {1.75} and len(got) == 6
    with pytest.raises(ValueError):
        T.parse_newick("((a,b);")


def test_streams(spark, tmp_path):
    src = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    src.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "e"))
    q = event_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 100
    infer(spark, _observations(), Config(burnin=1, n_samples=2, checkpoint=1), 1).write.parquet(str(tmp_path / "t"))
    seen = []
    w = watch_trace(read_trace_stream(spark, str(tmp_path / "t")), str(tmp_path / "c"), lambda df, k: seen.append(df.count()))
    w.awaitTermination()
    assert sum(seen) == spark.read.parquet(str(tmp_path / "t")).count()


def test_commands(spark, folder, tmp_path):
    p = lambda n: str(tmp_path / n)
    cli.main(["parse-input", "--folder", folder, "--out", p("study")])
    cli.main(["filter", "--study", p("study"), "--dtype", "raw", "--threshold", "5", "--min-num-consecutive", "2", "--out", p("f")])
    assert {r["name"] for r in S.load_study(spark, p("f")).taxa.collect()} == {"T1", "T2"}
    cli.main(["infer", "--study", p("f"), "--n-samples", "4", "--burnin", "2", "--checkpoint", "2", "--out", p("trace")])
    cli.main(["extract-posterior", "--trace", p("trace"), "--burnin", "2", "--out", p("post")])
    assert spark.read.parquet(p("post/vectors")).count() == 4
    cli.main(["extract-abundances", "--study", p("f"), "--time", "0", "--limit-of-detection", "1", "--out", p("x0.tsv")])
    cli.main(["forward-simulate", "--study", p("f"), "--trace", p("trace"), "--initial", p("x0.tsv"), "--limit-of-detection", "1", "--n-days", "2", "--dt", "0.5", "--out", p("sim")])
    assert spark.read.parquet(p("sim")).count() == 2 * 4 * 3 * 2
    spark.createDataFrame([(0, 0), (1, 1)], "item int, cid int").write.parquet(p("cl"))
    cli.main(["evaluate-keystoneness", "--study", p("f"), "--trace", p("trace"), "--initial", p("x0.tsv"), "--clusters", p("cl"), "--limit-of-detection", "1", "--n-days", "2", "--dt", "0.5", "--out", p("ky")])
    assert spark.read.parquet(p("ky")).count() == 2
    cli.main(["plot-subjects", "--study", p("f"), "--level", "phylum", "--out", p("plot")])
    cli.main(["interaction-to-cytoscape", "--trace", p("trace"), "--out", p("net")])
    cli.main(["infer-negbin", "--study", p("study"), "--n-samples", "20", "--burnin", "5", "--out", p("nb")])
    cli.main(["visualize-negbin", "--trace", p("nb"), "--out", p("nbv")])
    (tmp_path / "tree.nwk").write_text("((T1:0.01,R1:0.02):0.01,(T2:0.02,R2:0.03):0.02);")
    cli.main(["render-phylogeny", "--study", p("f"), "--tree", p("tree.nwk"), "--out", p("phy")])
    assert spark.read.parquet(p("phy")).count() > 0


def test_r_hat_of_equal_chains_is_near_one(spark):
    rng = D.generator(4, "r")
    rows = [(c, g, 0, float(v)) for c in range(4) for g, v in enumerate(rng.normal(size=300))]
    t = spark.createDataFrame(rows, "chain bigint, gibbs bigint, idx int, value double")
    assert P.r_hat(t, ["idx"]).first()["rhat"] == pytest.approx(1, abs=0.05)
    n = t.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    assert P.split_r_hat(t, ["idx"], n).first()["rhat"] == pytest.approx(1, abs=0.05)
