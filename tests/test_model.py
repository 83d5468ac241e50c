import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.functions import debug, names
from strandline.functions import distributions as D
from strandline.inference.data import Observations, Series, observe
from strandline.inference.gibbs import ABSENT, Chain, Config
from strandline.inference.negbin import calibrate
from strandline.inference.run import infer, infer_to
from strandline.operators import clusters as C
from strandline.operators import graphs as G
from strandline.operators import kernels as K
from strandline.operators import posterior as P
from strandline.sources import dataset as DS
from strandline.sources import tables as S
from test_study_and_cli import FILES, _observations


def known_system(noise=1e-4):
    """Observations of the three-cluster system, densely and precisely measured."""
    s = K.synthetic_system(13, 0)
    rng = D.generator(5, "known")
    series = []
    for j in range(4):
        times = np.arange(0, 30, 1.0)
        x0 = rng.uniform(0.2, 3, 13)
        x = K.simulate_batch(x0, s["growth"][None], s["interactions"][None], 0.1, 30.0, keep=np.rint(times / 0.1).astype(int), noise=noise, rng=rng)[0]
        reads, q = K.measure(x, 1e-10, 1e-4, 0.02, 500_000, rng)
        series.append(Series(f"s{j}", times, reads, list(np.log(q)), np.zeros((len(times) - 1, 0))))
    return s, Observations([f"t{i}" for i in range(13)], [], series)


def test_sampler_recovers_a_known_system(spark):
    truth, obs = known_system()
    cfg = Config(burnin=60, n_samples=160, checkpoint=160, qpcr_scale=0.02, a1=1e-4, clusters="fixed", fixed=tuple(truth["cluster"].tolist()))
    trace = infer(spark, obs, cfg, 2).where("gibbs >= 60").toPandas()
    mean = trace[trace["var"] == "growth"].groupby("i")["value"].mean().to_numpy()
    # the growth of the first cluster can't be told from what the nearly constant second one adds to it
    assert np.abs(mean / truth["growth"] - 1)[truth["cluster"] > 0].mean() < 0.15
    n = 200
    on = trace[trace["var"] == "interaction"].groupby(["i", "j"])["value"]
    share, weight = on.count() / n, on.sum() / n
    real = [(i, j) for i in range(13) for j in range(13) if i != j and truth["interactions"][i, j] != 0]
    none = [(i, j) for i in range(13) for j in range(13) if truth["cluster"][i] != truth["cluster"][j] and truth["interactions"][i, j] == 0]
    assert np.mean([share.get(e, 0) for e in real]) > 0.7 > 0.3 > np.mean([share.get(e, 0) for e in none])
    assert np.mean([np.sign(weight.get(e, 0)) == np.sign(truth["interactions"][e]) for e in real]) > 0.9


def test_a_broken_run_goes_on_from_disk(spark, tmp_path, monkeypatch):
    obs, cfg = _observations(), Config(burnin=4, n_samples=9, checkpoint=3)
    whole = infer(spark, obs, cfg, 2).where("var <> 'state'").toPandas()
    folder = str(tmp_path / "trace")
    sweep = Chain.one_sweep

    class Died(Exception):
        pass

    from strandline.inference import run as R

    real, blocks = R.infer, []

    def dies(*a):
        if len(blocks) == 2:
            raise Died
        blocks.append(1)
        return real(*a)

    monkeypatch.setattr(R, "infer", dies)
    with pytest.raises(Died):
        infer_to(spark, obs, cfg, folder, 2)
    monkeypatch.setattr(R, "infer", real)
    assert S.read_trace(spark, folder, "growth").agg(F.max("gibbs")).first()[0] == 5  # two blocks are there
    assert infer_to(spark, obs, cfg, folder, 2) == 1 and infer_to(spark, obs, cfg, folder, 2) == 0
    again = S.read_trace(spark, folder).where("var <> 'state'").toPandas()
    key = ["chain", "var", "gibbs", "i", "j"]
    a, b = (x.astype({"chain": "int64", "var": "object"}).sort_values(key)[[*key, "value"]].reset_index(drop=True) for x in (whole, again))
    assert a.astype(str).equals(b.astype(str)) and Chain.one_sweep is sweep


def test_sparse_and_dense_traces_agree(spark):
    rows = [(c, g, e, float(g + e + c) if (g + e + c) % (e + 2) == 0 else None) for c in range(3) for g in range(10) for e in range(5)]
    dense = spark.createDataFrame(rows, "chain bigint, gibbs bigint, e int, value double")
    sparse = dense.where("value is not null and not (e = 4 and chain = 1)")
    dense = dense.withColumn("value", F.when(~((F.col("e") == 4) & (F.col("chain") == 1)), F.col("value")))
    n = spark.createDataFrame([(c, 10) for c in range(3)], "chain bigint, n bigint")

    def same(a, b):
        a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()) for x in (a, b))
        assert a == b

    same(P.summary(dense, ["e"], nan_to_zero=True), P.summary(sparse, ["e"], draws=30))
    same(P.bayes_factors(dense, ["e"], 1.0, 4.0), P.bayes_factors(sparse, ["e"], 1.0, 4.0, draws=30))
    same(P.r_hat(dense, ["e"]), P.r_hat(sparse, ["e"], lengths=n))
    same(P.split_r_hat(dense, ["e"], n), P.split_r_hat(sparse, ["e"], n))


def test_structural_zeros_are_left_alone():
    obs = _observations()
    there = np.ones(obs.series[0].reads.shape, bool)
    there[:4, 2] = False
    masked = Observations(obs.taxa, obs.perturbations, [Series(s.name, s.times, s.reads, s.log_qpcr, s.active, there) for s in obs.series])
    c = Chain(masked, Config(burnin=4, n_samples=8, learn_qpcr=True, qpcr_buckets=2), 0)
    assert len(c.qscale) == 2
    for _ in range(8):
        c.one_sweep()
        assert all((x[:4, 2] == ABSENT).all() and (x[there] > ABSENT).all() for x in c.x)
    assert c.mask[:, 2].sum() == c.mask[:, 0].sum() - 8 and np.isfinite(c.a1).all() and c.xs[0, 2] == 0
    again = Chain.resume(masked, c.cfg, 0, c.save())
    assert np.array_equal(again.qscale, c.qscale) and all(np.array_equal(a, b) for a, b in zip(again.x, c.x))


def test_start_clusters():
    c = Chain(_observations(), Config(start=(3, 3, 1, 1, 2)), 0)
    assert c.z.tolist() == [2, 2, 0, 0, 1]


def test_replicates_of_any_number_of_subjects(spark, monkeypatch):
    """One dense matrix of all subjects was made first, and raised beyond MAX_CELLS."""
    from strandline.inference import data
    from strandline.operators.study import Study

    monkeypatch.setattr(data, "MAX_CELLS", 5)
    names = ["X", "Y", "Z", "W"]
    taxa = spark.createDataFrame([(2 * i, n) for i, n in enumerate(names)], "idx int, name string")
    samples = [(f"{p}-{k}", p, float(k), k) for p, n in (("A", 3), ("B", 2), ("C", 2)) for k in range(n)]
    reads = [("A-0", "Y", 4), ("A-2", "X", 7), ("A-2", "Y", 1), ("B-0", "Z", 2), ("B-1", "W", 0), ("C-0", "W", 5), ("C-1", "Z", 3), ("C-1", "Y", 0)]
    s = Study(taxa, spark.createDataFrame(samples, "sample_id string, subject string, time double, tidx int"), spark.createDataFrame(reads, "sample_id string, taxon string, count bigint"), None, None)
    assert [r.tolist() for r in data.replicate_reads(s)] == [[[0, 4], [7, 1]], [[0, 5], [3, 0]]]
    assert data.replicate_reads(s.replace(reads=s.reads.limit(0))) == []


def test_calibration_finds_the_dispersion():
    rng = D.generator(7, "replicates")
    groups = [D.sample_negbin(rng, 50_000 * rng.dirichlet(np.ones(12)), 0.05, (8, 12)) for _ in range(2)]
    a0, a1 = calibrate(groups, burnin=200, n_samples=500)
    assert 0.02 < np.median(a1[200:]) < 0.12
    assert len(calibrate(np.zeros((3, 4), int), n_samples=5)[0]) == 5


def test_species_policies(spark):
    rows = [("a", "x / y", "y/z"), ("b", "NA", "q"), ("c", None, ""), ("d", "x", "NA"), ("e", "x/x", None), ("f", "a/b/c", "a")]
    df = spark.createDataFrame(rows, "name string, silva string, rdp string")
    want = {
        "both": ["NA", "q", "NA", "x", "x", "NA"], "silva": ["x/y", "NA", "NA", "x", "x", "NA"], "rdp": ["y/z", "q", "NA", "NA", "NA", "a"],
        None: ["NA"] * 6,
    }
    for policy, labels in want.items():
        assert [r[0] for r in df.orderBy("name").select(DS.species_by_policy(policy)).collect()] == labels
    assert df.where("name = 'a'").select(DS.species_by_policy("both", most=3)).first()[0] == "x/y/z"
    with pytest.raises(ValueError, match="policy"):
        DS.species_by_policy("other")


def test_dataset_loader(spark, tmp_path):
    for n, t in FILES.items():
        (tmp_path / f"{n}.tsv").write_text(t)
    (tmp_path / "species_rdp.tsv").write_text("name\tspecies\nT1\tcoli\n")
    s = DS.load_dataset(spark, str(tmp_path), {"few": ["s1", "s4"]}, "few", "both")
    assert {r["sample_id"] for r in s.samples.collect()} == {"s1", "s4"} == {r["sample_id"] for r in s.qpcr.collect()}
    assert {r["name"]: r["species"] for r in s.taxa.collect()} == {"T1": "coli", "T2": "NA", "T3": "NA"}
    assert DS.load_dataset(spark, str(tmp_path), None, "inoculum").samples.count() == 0
    assert DS.load_dataset(spark, str(tmp_path), with_perturbations=False).perts.count() == 0
    with pytest.raises(ValueError, match="cohort"):
        DS.load_dataset(spark, str(tmp_path), None, "none")
    (tmp_path / "mask.tsv").write_text("taxon\ttime\nT1\t1\nT9\t5\n")
    mask = DS.zero_inflation_mask(spark, str(tmp_path / "mask.tsv"))
    study = DS.load_dataset(spark, str(tmp_path))
    assert study.cells.count() - DS.present_cells(study, mask).count() == 2
    assert [s.there[:, 0].tolist() for s in observe(study, mask=mask).series] == [[False, True, True], [False, True]]


def test_clusterings(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("c1\tT1\nc2\tT2\nc1\tT3\n")
    (tmp_path / "b.tsv").write_text("Cluster 1\n\tT1\n\tT3\nCluster 2\n\tT2\n")
    for n in "ab":
        assert S.clustering_of(S.read_clustering(spark, str(tmp_path / f"{n}.tsv")), ["T1", "T2", "T3"]) == (0, 1, 0)
    with pytest.raises(S.BadStudy, match="T4"):
        S.clustering_of(S.read_clustering(spark, str(tmp_path / "a.tsv")), ["T1", "T4"])
    m = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "item int, cid int")
    pairs = spark.createDataFrame([(1, 0)], "cid int, into int")
    assert {r["cid"] for r in C.merge_clusters(m, pairs).collect()} == {0}
    co = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 2, 0.2)], "a int, b int, p double")
    counts = spark.createDataFrame([(2, 5), (3, 1)], "n_clusters int, n_draws int")
    for k in (2, lambda draws: draws.mode()[0]):
        got = {r["item"]: r["cid"] for r in C.consensus_clusters(co, 3, k, counts).collect()}
        assert got[0] == got[1] != got[2]


def test_descendants_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], "parent string, child string")
    got = {tuple(r) for r in G.descendants(e, spark.createDataFrame([("a",), ("q",)], "node string")).select("root", "node", "steps").collect()}
    assert got == {("a", "b", 1), ("a", "c", 2)}


def test_semisynthetic_and_cached_steady_states(spark, tmp_path):
    edges = np.array([[0, 0, 2.0], [0, 0, 9.0], [np.nan, 1.0, 0]])
    bayes = np.array([[0, 0, 50.0], [0, 0, 1.0], [50.0, 0, 0]])
    s = K.semisynthetic_system(np.ones(3), np.full(3, 0.5), edges, bayes, np.array([0, 0, 1]), 10.0)
    assert np.array_equal(s["interactions"], [[-0.5, 0, 2], [0, -0.5, 2], [0, 0, -0.5]])
    rows = spark.createDataFrame([(0, 0, i, 0.1) for i in range(2)], "chain bigint, gibbs bigint, idx int, value double")
    none = spark.createDataFrame([], "chain bigint, gibbs bigint, tgt int, src int, value double")
    params = K.draws(rows, rows, none)
    folder = str(tmp_path / "steady")
    first = K.cached_steady_states(folder, params, np.ones(2), 0.1, 5.0, {0: [0]}).collect()
    again = K.cached_steady_states(folder, params.limit(0), np.ones(2), 0.1, 5.0, {}).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 4


def test_densities():
    rng = D.generator(1, "d")
    x = rng.beta(2, 3, 200_000)
    h, edges = np.histogram(x, 20, (0, 1), density=True)
    assert np.abs(np.exp(D.beta_logpdf((edges[1:] + edges[:-1]) / 2, 2, 3)) - h).max() < 0.05
    assert D.bernoulli_logpmf(1, 0.25) == pytest.approx(np.log(0.25)) and D.beta_logpdf(1.5, 2, 3) == -np.inf
    assert abs(D.sample_bernoulli(rng, 0.3, 100_000).mean() - 0.3) < 0.01
    v = D.sample_inverse_chi2(rng, 7.0, 200_000)
    assert v.mean() == pytest.approx(1 / 5, rel=0.02) and np.isfinite(D.inverse_chi2_logpdf(v, 7.0)).all()
    cov = np.array([[2.0, 0.6], [0.6, 1.0]])
    assert np.abs(np.cov(D.sample_mvn(rng, [1, 2], cov, 100_000).T) - cov).max() < 0.05
    assert np.isfinite(D.safe_cholesky(np.ones((3, 3)))).all() and D.log_det(np.eye(3) * 2) == pytest.approx(3 * np.log(2))


def test_names_and_debug(caplog):
    assert names.is_perturbation_parameter("perturbation_mean") and not names.is_perturbation_parameter("growth")
    assert names.latex("growth") == "$a_{1}$" and names.latex("what_ever") == r"what\_ever"
    seen = []
    f = debug.timed(debug.watch_values(seen.append, 2)(debug.count_calls(3)(lambda x: x + 1)))
    assert [f(k) for k in range(3)] == [1, 2, 3] and seen == [1, 2] and f.calls == 3 and f.seconds >= 0
    with pytest.raises(RuntimeError, match="more than 3"):
        f(9)
    with caplog.at_level(logging.DEBUG, "strandline"), debug.Timer("t") as t:
        pass
    assert t.seconds >= 0 and "t: " in caplog.text


def test_perturbed_and_fixed_commands(spark, tmp_path):
    for n, t in FILES.items():
        (tmp_path / f"{n}.tsv").write_text(t)
    p = lambda n: str(tmp_path / n)
    (tmp_path / "fixed.tsv").write_text("c1\tT1\nc1\tT2\nc2\tT3\n")
    (tmp_path / "x0.tsv").write_text("T1\t1\nT2\t2\nT3\t3\n")
    cli.main(["parse-input", "--folder", str(tmp_path), "--out", p("study")])
    cli.main(["infer-negbin", "--study", p("study"), "--n-samples", "6", "--burnin", "2", "--out", p("nb")])
    cli.main(["infer", "--study", p("study"), "--negbin", p("nb"), "--n-samples", "4", "--burnin", "2", "--checkpoint", "2", "--fixed-clustering", p("fixed.tsv"), "--out", p("trace")])
    got = {r["i"]: r["value"] for r in S.read_trace(spark, p("trace"), "cluster").collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0}
    sim = ["forward-simulate", "--study", p("study"), "--trace", p("trace"), "--initial", p("x0.tsv"), "--limit-of-detection", "1", "--n-days", "2", "--dt", "0.5"]
    cli.main([*sim, "--out", p("plain")])
    S.read_trace(spark, p("trace")).where("var <> 'perturbation'").unionByName(
        spark.range(2).selectExpr("2 as gibbs", "0 as i", "0 as j", "5.0D as value", "cast(null as binary) as state", "cast(id as int) as chain", "'perturbation' as var")
    ).write.partitionBy("chain", "var").parquet(p("perturbed"))
    sim[4] = p("perturbed")
    cli.main([*sim, "--subject", "A", "--out", p("with")])
    a, b = (spark.read.parquet(p(n)).where("gibbs = 2 and taxon = 0 and time = 1").agg(F.sum("x")).first()[0] for n in ("plain", "with"))
    assert b > a


def test_steady_states_settle_on_the_analytic_ones(spark):
    growth = spark.createDataFrame([(0, 0, 0, 0.8), (0, 0, 1, 0.5)], "chain bigint, gibbs bigint, idx int, value double")
    own = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 1.0)], "chain bigint, gibbs bigint, idx int, value double")
    edges = spark.createDataFrame([(0, 0, 0, 1, 0.3)], "chain bigint, gibbs bigint, tgt int, src int, value double")
    got = K.steady_states(K.draws(growth, own, edges), np.array([0.1, 0.2]), 0.01, 60.0, {7: [1]}).collect()
    x = {(r["scenario"], r["taxon"]): r["x"] for r in got}
    want = np.linalg.solve([[-2.0, 0.3], [0, -1.0]], [-0.8, -0.5])
    assert [x[None, 0], x[None, 1]] == pytest.approx(want, rel=1e-6) and x[7, 0] == pytest.approx(0.4, rel=1e-6) and x[7, 1] == 0


def test_weights_stand_for_copies():
    rng = D.generator(3, "w")
    p = rng.normal(size=(9, 2))
    many = np.repeat(p, [1, 3, 1, 2, 1, 1, 4, 1, 1], axis=0)
    full = K.agglomerate(np.abs(many[:, None] - many[None]).sum(2), n_clusters=3)
    one = K.agglomerate(np.abs(p[:, None] - p[None]).sum(2), n_clusters=3, weights=np.array([1, 3, 1, 2, 1, 1, 4, 1, 1]))
    first = np.cumsum([0, 1, 3, 1, 2, 1, 1, 4, 1])
    assert full[first].tolist() == one.tolist()


class _Climber:
    """A random stream whose steps are known and that takes a step only if it gains."""

    def __init__(self):
        self.steps = np.random.default_rng(4)

    def permutation(self, n):
        return np.arange(n)

    def standard_normal(self, n):
        return self.steps.standard_normal(n)

    def standard_exponential(self, n):
        return np.zeros(n)


@pytest.mark.parametrize("masked", [False, True])
def test_steps_of_trajectories_weigh_the_whole_density(masked):
    """What a step changes is summed up by clusters and weighed for all subjects at once: the same steps are taken as by
    the density of everything, worked out anew for each."""
    obs = _observations(6)
    there = np.ones(obs.series[0].reads.shape, bool)
    if masked:
        there[:3, 2], there[:5, 4] = False, False
    obs = Observations(obs.taxa, obs.perturbations, [Series(s.name, s.times, s.reads * there * (np.arange(6) < 5), s.log_qpcr, s.active, there if masked else None) for s in obs.series])
    c = Chain(obs, Config(clusters="fixed", fixed=(0, 1, 0, 2, 1, 2), a0=1e-3, qpcr_scale=0.1), 0)
    c.edge, c.on = np.array([[9, 0.3, -0.2], [0.1, 9, 0], [-0.4, 0.2, 9]]), np.array([[0, 1, 1], [1, 0, 0], [1, 1, 0]], bool)
    c.gamma, c.gon = np.array([[0.5], [-0.2], [0.3]]), np.array([[1], [0], [1]], bool)
    c.step[:] = 0.4
    start, b = [x.copy() for x in c.x], c.edge * c.on
    full = b[np.ix_(c.z, c.z)] * (c.z[:, None] != c.z) - np.diag(c.a2)

    def density(s, x):
        here = s.there
        seen = np.where(here, x, 0.0)
        rate = c.a1 * (1 + s.active @ (c.gamma * c.gon)[c.z].T) + seen[:-1] @ full.T
        e = np.diff(np.log(x), axis=0) - s.dt[:, None] * rate
        out = -(e**2 * (here[:-1] & here[1:]) / (2 * s.dt[:, None] * c.s2)).sum()
        total = seen.sum(1)
        rel = np.maximum(x / total[:, None], 1e-12)
        out += (D.negbin_logpmf(s.reads, s.reads.sum(1)[:, None] * rel, c.cfg.a0 / rel + c.cfg.a1) * here).sum()
        return out - sum(((q + np.log(c.scale) - np.log(t)) ** 2).sum() for q, t in zip(s.log_qpcr, total)) / (2 * c.cfg.qpcr_scale**2)

    c.rng = _Climber()
    c.update_latent()
    steps, taken = np.random.default_rng(4), 0
    for i in range(6):
        for parity in (0, 1):
            at = [(j, k) for j, s in enumerate(obs.series) for k in range(parity, len(s.times), 2) if s.there[k, i]]
            for (j, k), z in zip(at, steps.standard_normal(len(at))):
                x = start[j].copy()
                x[k, i] *= np.exp(0.4 * z)
                if density(obs.series[j], x) > density(obs.series[j], start[j]):
                    start[j], taken = x, taken + 1
    assert 10 < taken == c.taken.sum() < c.tries.sum() - 10
    assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(start, c.x))


def test_clusters_are_weighed_by_products():
    c = Chain(_observations(6), Config(), 0)
    for _ in range(3):
        c.one_sweep()
    z, rng = np.array([0, 1, 1, 2, 0, 2]), D.generator(1, "on")
    on, gon = rng.random((3, 3)) < 0.6, np.array([[True], [False], [True]])
    want = 0.0
    for t in range(3):
        mean, var, free = c.priors(t, 3)
        want += c.marginal(*c.statistics(z, t), mean, var, np.flatnonzero(np.concatenate([on[t], gon[t]]) & free))
    assert c.log_marginal(z, on, gon, c.products(5)) == pytest.approx(want) == c.log_marginal(z, on, gon)
    for n in (1, 2, 6, 9, 30):
        t, y = np.sort(rng.uniform(0, 50, n)), rng.normal(size=n)
        assert K.loess_matrix(t, 6) @ y == pytest.approx(K.loess(t, y, 6))


def test_a_chain_holds_one_array_of_taxa_times_samples():
    """A chain held a dozen arrays of that size, so a study of 31 million cells was refused."""
    import tracemalloc

    rng = D.generator(2, "wide")
    series = []
    for j in range(60):
        reads = np.zeros((25, 200), np.uint16)
        reads[:, rng.integers(0, 200, 2)] = rng.integers(1, 900, (25, 2))
        series.append(Series(f"s{j}", np.arange(25.0), reads, [rng.normal(20, 0.3, 2) for _ in range(25)], np.zeros((24, 0))))
    obs = Observations([f"t{i}" for i in range(200)], [], series)
    tracemalloc.start()
    try:
        c = Chain(obs, Config(clusters="fixed", fixed=tuple(i % 3 for i in range(200))), 0)
        c.one_sweep()
        assert tracemalloc.get_traced_memory()[1] < 2.5 * 8 * 200 * 60 * 25
    finally:
        tracemalloc.stop()
    from strandline.inference.data import MAX_CELLS

    assert 261 * 117_240 <= MAX_CELLS


def test_trajectories_of_any_number_of_cells(spark, monkeypatch):
    """A study of more than MAX_CELLS cells was refused."""
    from strandline.inference import data
    from strandline.operators.study import Study

    samples = [(f"A-{k}", "A", float(k), k) for k in range(4)]
    reads = [(f"A-{k}", n, 5 + k * i) for k in range(4) for i, n in enumerate("XYZ")]
    s = Study(
        spark.createDataFrame([(i, n) for i, n in enumerate("XYZ")], "idx int, name string"),
        spark.createDataFrame(samples, "sample_id string, subject string, time double, tidx int"),
        spark.createDataFrame(reads, "sample_id string, taxon string, count bigint"),
        spark.createDataFrame([("A-0", 8.0), ("A-2", 9.0)], "sample_id string, density double"),
        spark.createDataFrame([], "name string, pidx int, subject string, start double, end double"),
    )
    cfg = Config(burnin=4, n_samples=8)
    runs = {}
    for cells, held in ((100, 100), (5, 100), (5, 5)):
        monkeypatch.setattr(data, "MAX_CELLS", cells)
        monkeypatch.setattr(data, "MAX_HELD", held)
        c = Chain(data.observe(s), cfg, 0)
        for _ in range(3):
            c.one_sweep()
        assert c.lx.dtype == (np.float64 if cells == 100 else np.float32) and isinstance(c.lx, np.memmap) == (held == 5)
        again = Chain.resume(c.obs, cfg, 0, c.save())
        c.one_sweep(), again.one_sweep()
        assert np.array_equal(c.lx, again.lx) and np.array_equal(c.a1, again.a1)
        runs[cells, held] = c
    a, b, c = runs.values()
    assert np.array_equal(b.lx, c.lx) and np.allclose(a.lx, b.lx, atol=1e-3) and np.allclose(a.a1, b.a1, rtol=1e-2)
