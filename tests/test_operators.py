"""Invariants of the analytic operators against plain NumPy formulas, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import bases as B
from driftloom.operators import detectors as D
from driftloom.operators import episodes as E
from driftloom.operators import metrics as M
from driftloom.operators import pairs as P
from driftloom.operators import reduction as R
from driftloom.operators import windows as W
from driftloom.plans import experiment
from driftloom.sources import tables as T
from driftloom.streaming import scoring as X

RNG = np.random.default_rng(42)
POINTS, OTHERS = RNG.normal(size=(50, 5)), RNG.normal(size=(20, 5))
KERNELS = [P.Kernel("rbf", gamma=1.0), P.Kernel("rbf", gamma=0.5), P.Kernel("linear"), P.Kernel("poly", degree=2), P.Kernel("laplace", gamma=0.3), P.Kernel("abel", gamma=0.3), P.Kernel("polyfft"), P.Kernel("gaussfft")]


@pytest.mark.parametrize("kernel", KERNELS, ids=lambda k: f"{k.name}{k.gamma}")
def test_kernels(kernel):
    g = kernel(POINTS, POINTS)
    assert np.allclose(g, g.T) and np.linalg.eigvalsh(g).min() > -1e-8 * np.abs(g).max() and np.allclose(np.diag(g), kernel.diag(POINTS), atol=1e-6)


@pytest.mark.parametrize("kernel", KERNELS[:4], ids=lambda k: f"{k.name}{k.gamma}")
def test_exact_kernel_score(kernel):
    lam = 1e-2
    m = D.KernCD.fit_points(POINTS, kernel, lam)
    a = kernel(POINTS, POINTS) + lam * 50 * np.eye(50)
    k = kernel(OTHERS, POINTS)
    want = kernel.diag(OTHERS) - np.einsum("ij,jk,ik->i", k, np.linalg.inv(a), k)
    assert np.allclose(m.score_points(OTHERS), want)
    assert m.score_points(OTHERS + 10).mean() > m.score_points(OTHERS).mean()


@pytest.mark.parametrize("pivot", ["greedy", "rp", "uniform"])
def test_pivoted_cholesky(pivot):
    f, pivots = D.pivoted_cholesky(P.Kernel("rbf", gamma=0.1), POINTS, 50, pivot=pivot)
    assert np.allclose(f @ f.T, P.Kernel("rbf", gamma=0.1)(POINTS, POINTS), atol=1e-4) and len(set(pivots)) == len(pivots)
    low, _ = D.pivoted_cholesky(P.Kernel("linear"), POINTS, 50, pivot=pivot)
    assert low.shape[1] == 6 or pivot == "uniform"
    twice = np.vstack((POINTS[:5], POINTS[:5]))
    f, _ = D.pivoted_cholesky(P.Kernel("rbf"), twice, 10, pivot=pivot)
    assert np.allclose(f @ f.T, P.Kernel("rbf")(twice, twice), atol=1e-5)


def test_low_rank_equals_exact_where_the_rank_is_enough():
    kernel = P.Kernel("linear")
    exact = D.KernCD.fit_points(POINTS, kernel, 0.01).score_points(OTHERS)
    assert np.allclose(D.KernCD.fit_points(POINTS, kernel, 0.01, rank=6, pivot="greedy").score_points(OTHERS), exact, atol=1e-6)
    rbf = P.Kernel("rbf", gamma=0.1)
    a, b = D.KernCD.fit_points(POINTS, rbf, 0.01).score_points(np.vstack((OTHERS, OTHERS + 6))), D.KernCD.fit_points(POINTS, rbf, 0.01, rank=25).score_points(np.vstack((OTHERS, OTHERS + 6)))
    assert np.corrcoef(a, b)[0, 1] > 0.9


def test_online_update():
    kernel = P.Kernel("rbf", gamma=0.5)
    m = D.KernCD.fit_points(POINTS[:15], kernel, 1e-4)
    one, many = m.update(POINTS[15]).update(POINTS[16]), m.batch_update(POINTS[15:17])
    assert np.allclose(one.score_points(OTHERS), many.score_points(OTHERS))
    assert np.allclose(m.update(POINTS[15], exact=True).score_points(OTHERS), D.KernCD.fit_points(POINTS[:16], kernel, 1e-4).score_points(OTHERS))
    assert np.allclose(one.score_points(OTHERS), D.KernCD.fit_points(POINTS[:17], kernel, 1e-4).score_points(OTHERS), rtol=0.1, atol=1e-3)


def test_moment_score_has_mean_of_its_size(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in RNG.normal(size=(500, 2))], "a double, b double")
    for basis in ("monomial", "chebyshev", "hermite"):
        m = D.CDPolynomial.fit(df, ["a", "b"], 2, basis)
        mean = m.score(df).agg(F.avg("score")).first()[0]
        assert abs(mean - 6) < 1e-6 and abs(m.mean_score - 6) < 1e-6
    v = B.features_np(np.array([[0.3, -0.2]]), 2)
    assert [round(x, 6) for x in v[0]] == [1, 0.3, -0.2, 0.09, -0.06, 0.04]
    mixed = df.unionByName(spark.createDataFrame([(None, 1.0)], df.schema))
    assert D.CDPolynomial.fit(mixed, ["a", "b"], 1).score(mixed).filter("score is null").count() == 1


def test_bases():
    assert len(B.total_degree(3, 4)) == 35 and B.gaussian_moment(4, 2.0) == 48 and B.gaussian_moment(3, 2.0) == 0
    assert abs(B.ball_moment((2,)) - 1 / 3) < 1e-12 and abs(B.ball_moment((2, 0)) - 0.25) < 1e-12
    for kind in ("gaussian", "vonmises", "sine", "fourier", "bspline"):
        b = B.temporal_matrix(kind, 60, 7)
        assert b.shape == (60, 7) and np.allclose(b @ (B.encoder(b) @ (b @ np.arange(7.0))), b @ np.arange(7.0), atol=1e-3)
    assert np.allclose(B.temporal_matrix("bspline", 60, 7).sum(1), 1)
    c = B.chebyshev_from_nodes(B.chebyshev_nodes(6) ** 3)
    assert np.allclose(np.polynomial.chebyshev.chebval(B.chebyshev_nodes(9), c), B.chebyshev_nodes(9) ** 3)


def test_reductions():
    low = np.einsum("nk,tk,dk->ntd", RNG.normal(size=(30, 3)), RNG.normal(size=(50, 3)), RNG.normal(size=(6, 3)))
    flat = low.reshape(30, -1)
    fit = lambda k: R.Tucker13.from_moments(30, flat.sum(0), flat.T @ flat, 6, k, k, alpha=0.0)
    assert fit(3).error < 1e-6 and fit(1).error > fit(2).error
    b = B.temporal_matrix("bspline", 50, 50 - 3)
    f = R.nystrom(POINTS, P.Kernel("rbf", gamma=0.1))
    assert np.allclose(f(OTHERS) @ f(POINTS).T, P.Kernel("rbf", gamma=0.1)(OTHERS, POINTS), atol=1e-3)
    k = R.sequence_kernel(RNG.normal(size=(4, 9, 2)), RNG.normal(size=(3, 9, 2)), P.Kernel("rbf"))
    assert k.shape == (4, 3) and (np.abs(k) <= 1).all()
    phi = R.random_fourier(5, 0.1, 4096)
    assert np.abs(phi(OTHERS) @ phi(POINTS).T - P.Kernel("rbf", gamma=0.1)(OTHERS, POINTS)).max() < 0.1


def states_of(spark, episodes):
    return spark.createDataFrame([(e, t, None if v is None else float(v)) for e, xs in episodes.items() for t, v in enumerate(xs)], "ep long, t long, x double")


def test_windows_edges(spark):
    s = states_of(spark, {1: [1, 2, None, 4, 5, 6], 2: [1, 2], 3: [None, None, None]})
    got = sorted((r.ep, r.end, list(r.w)) for r in W.sliding(s, ["x"], 3).collect())
    assert got == [(1, 5, [4, 5, 6])]
    assert W.sliding(s.limit(0), ["x"], 3).count() == 0


def test_conformal_and_metrics_edges(spark):
    with pytest.raises(ValueError):
        M.conformal_level(0, 0.1)
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 1, 5.0), (2, 0, 1.0), (2, 1, None), (3, 0, 9.0)], "ep long, end long, z double")
    eps = spark.createDataFrame([(1, 2, 2), (2, 2, 1), (3, 2, 0)], "ep long, n_steps long, fail long")
    row = M.detection_metrics(scores, eps, 4.0).first()
    assert (row.n_survived, row.n_failed, row.fpr, row.detection_rate, row.median_lead) == (1, 1, 1.0, 0.0, None)
    none = M.detection_metrics(scores, eps.filter("fail < n_steps"), 4.0).first()
    assert none.fpr is None
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert M.auroc(one).first().auroc is None


def test_oracle_detector_has_no_lead_and_no_false_alarm(spark):
    eps = {1: [0, 0, 9, 9], 2: [0, 0, 0, 0], 3: [9, 9, 9, 9]}
    s = states_of(spark, eps)
    e = E.first_failures(s, F.col("x") > 5)
    a = M.first_alarms(s.select("ep", F.col("t").alias("end"), F.col("x").alias("score")), e, 5.0, "score").collect()
    assert {r.ep: r.signed_lead for r in a} == {1: 0, 2: None, 3: 0} and {r.ep: r.fired for r in a}[2] == 0


def test_zero_variance_and_sentinel(spark):
    s = states_of(spark, {1: [3, 3, 3]})
    assert [r.x for r in E.normalize_channels(s, ["x"]).collect()] == [0.0, 0.0, 0.0]
    e = spark.createDataFrame([(1, 5, -1), (2, 5, 2)], "ep long, n_steps long, fail long")
    assert {r.ep: r.fail for r in E.from_sentinel(e).collect()} == {1: 5, 2: 2}
    with pytest.raises(ValueError):
        E.split_indices(e, {"a": 0.7, "b": 0.7}, 0)


def test_sources(spark, tmp_path):
    x = RNG.normal(size=(3, 4, 2)).astype("float32")
    x[1, 2:] = np.nan
    np.savez(tmp_path / "data.npz", X=x)
    got = T.read_npz(spark, str(tmp_path / "data.npz"))
    assert got.count() == 10 and got.groupBy("ep").count().agg(F.min("count")).first()[0] == 2
    s = states_of(spark, {1: [1, 2]})
    T.save(s, str(tmp_path), "env", "a")
    with pytest.raises(Exception):
        T.save(s, str(tmp_path), "env", "a")
    T.save(s, str(tmp_path), "env", "a", overwrite=True)
    assert T.load(spark, str(tmp_path), "env", "a", ["x"]).count() == 2
    assert T.get_or_build(spark, str(tmp_path), "env", "b", lambda: s).count() == T.get_or_build(spark, str(tmp_path), "env", "b", lambda: 1 / 0).count()
    calls = []
    for _ in range(2):
        assert T.cached_fit({"k": 1}, s, str(tmp_path / "models"), lambda: calls.append(1) or {"m": 3}) == {"m": 3}
    assert len(calls) == 1
    with pytest.raises(KeyError):
        T.get_config({"a/b": {}}, "c")
    T.save_run({"a": 1}, spark.createDataFrame([(0.5,)], "fpr double"), s, str(tmp_path / "runs"), "r1")
    assert spark.read.parquet(str(tmp_path / "runs/runs")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    s = states_of(spark, {1: [1, 2, 9, 4, 5], 2: [1, 1, 1, 1, 1], 3: [7, 8]})
    src, width = str(tmp_path / "in"), 3
    for lo, hi in ((0, 2), (2, 5)):
        s.filter((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = X.windowed_scores(stream, width, lambda w: float(w.mean()), 4.5).writeStream.format("memory").queryName("scored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.ep, r.end): (round(r.score, 9), r.first_alarm) for r in spark.table("scored").collect()}
    want = {(r.ep, r.end): round(sum(r.w) / 3, 9) for r in W.sliding(s, ["x"], width).collect()}
    assert {k: v[0] for k, v in got.items()} == want and got[1, 4][1] == 3 and got[2, 4][1] == -1


def test_experiment_runs_without_failures(spark):
    s = states_of(spark, {i: RNG.normal(size=12) for i in range(40)})
    e = E.first_failures(s, F.col("x") > 1e9)
    r = experiment.run_experiment(s, e)
    row = r.metrics.first()
    assert row.n_failed == 0 and row.detection_rate is None and 0 <= row.fpr <= 1


def test_volumes_and_smoothed_moments(spark):
    from driftloom.operators import volume as V

    disc = lambda x: (x * x).sum(1)
    centres = RNG.normal(scale=0.5, size=(100, 2))
    v = V.importance_volume(spark, disc, 1.0, [-2, -2], [2, 2], centres, V.proposal_width(centres), 50_000)
    row = v.first()
    assert abs(row["volume"] - np.pi) < 5 * row["standard_error"] + 0.02
    inside = np.array([r.x for r in V.proposals(spark, disc, 1.0, 5000, low=[-2, -2], high=[2, 2]).collect()])
    assert (disc(inside) <= 1).all() and abs(len(inside) / 5000 - np.pi / 16) < 0.03
    p = np.array([[1.0, 0.3], [-0.5, 0.2]])
    z = RNG.normal(size=(400_000, 2)) * 0.4
    feats = B.features_np((p[:, None, :] + z[None]).reshape(-1, 2), 2)
    want = feats.T @ feats / len(z)
    assert np.allclose(V.smoothed_moments(p, 2, 0.4), want, atol=0.05)
    r = np.sqrt(RNG.uniform(size=400_000))[:, None] * 0.4
    t = RNG.uniform(0, 2 * np.pi, 400_000)
    feats = B.features_np((p[:, None, :] + (r * np.column_stack((np.cos(t), np.sin(t))))[None]).reshape(-1, 2), 2)
    assert np.allclose(V.smoothed_moments(p, 2, 0.4, "ball", mean=True), feats.T @ feats / len(feats), atol=0.02)


def test_nearest_match_searches_all_right_rows(spark):
    from driftloom.operators import matching as Y

    right, left = RNG.normal(size=(6000, 2)).round(2), np.vstack((RNG.normal(size=(800, 2)).round(2), [[30.0, -30.0]]))
    frame = lambda x, first: spark.createDataFrame([(first + i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    y, x = ((v - right.mean(0)) / right.std(0) for v in (right, left))
    d = np.sqrt(((x[:, None, :] - y[None]) ** 2).sum(2))
    for n in (4000, 300):
        got = {r.id: (r.match, r.distance) for r in Y.nearest_match(frame(left, 10_000), frame(right, 0), "id", ["a", "b"], n).collect()}
        assert len(got) == len(left) and all(abs(got[10_000 + i][1] - d[i].min()) < 1e-9 and abs(d[i, got[10_000 + i][0]] - d[i].min()) < 1e-9 for i in range(len(left)))
