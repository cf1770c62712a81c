"""Operators over all rows in blocks, ranks by slices, experiments with any method, and small sources."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import episodes as E
from driftloom.operators import matching as X
from driftloom.operators import metrics as M
from driftloom.operators import pairs as P
from driftloom.operators import reduction as R
from driftloom.operators import sequences as Q
from driftloom.operators import signals as S
from driftloom.plans import experiment
from driftloom.sources import tables as T

RNG = np.random.default_rng(12)


def table_of(spark, x, **more):
    rows = [(i, [float(v) for v in r], *[int(c[i]) for c in more.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {n} long" for n in more))


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    x, y = RNG.normal(size=(130, 3)), RNG.integers(0, 2, 130)
    df, d = table_of(spark, x, y=y), np.sqrt(P.squared_distances(x, x))
    np.fill_diagonal(d, 0)
    monkeypatch.setattr(P.meet, "__defaults__", (40,))
    near = {r.id: (r.score, r.kth) for r in P.knn_all(df, df, "v", "id", 4).collect()}
    want = np.sort(d, axis=1)[:, :4]
    assert all(np.allclose(near[i], (want[i].mean(), want[i][-1]), atol=1e-6) for i in range(130))
    k = P.Kernel("rbf", gamma=0.5)
    g = k(x, x)
    means = {r.id: r.k_mean for r in P.gram_all(df, df, "v", "id", k).collect()}
    assert np.allclose([means[i] for i in range(130)], g.mean(1), atol=1e-9)
    np.fill_diagonal(g, 0)
    ones, zeros = (y == 1).astype(float), (y == 0).astype(float)
    a, b = ones.sum(), zeros.sum()
    mmd = ones @ g @ ones / (a * (a - 1)) + zeros @ g @ zeros / (b * (b - 1)) - 2 * ones @ g @ zeros / (a * b)
    assert math.isclose(P.mmd2(df, "v", "id", F.col("y") == 1, k).first()[0], mmd, rel_tol=1e-9)
    plane = table_of(spark, np.column_stack((RNG.uniform(size=(600, 2)), np.zeros(600))))
    z = np.array([r.v for r in plane.orderBy("id").collect()])
    d = np.sqrt(P.squared_distances(z, z))
    np.fill_diagonal(d, np.inf)
    two = np.sort(d, axis=1)[:, :2]
    mu = np.sort(two[:, 1] / two[:, 0])[:540]
    u, v = np.log(mu), -np.log(1 - np.arange(1, 541) / 541)
    assert math.isclose(P.two_nn_dimension(plane, "v", "id").first()[0], (u * v).sum() / (u * u).sum(), rel_tol=1e-6)


def test_ranks_and_quantiles_by_slices(spark):
    values = [float(v) for v in RNG.integers(0, 60, 500)] + [None]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "s double, y int")
    plain = np.array(values[:-1])
    for q in (0.0, 0.1, 0.5, 0.77, 1.0):
        assert math.isclose(M.quantiles(df, "s", [q])[0], np.quantile(plain, q))
    assert M.quantiles(df.limit(0), "s", [0.5]) == [None]
    counts = df.filter("s is not null").groupBy("s").agg(F.count("*").alias("c"))
    run = {r.s: r.c_run for r in M.running(counts, "s", ["c"]).collect()}
    assert all(run[v] == (plain <= v).sum() for v in set(plain))
    down = {r.s: r.c_run for r in M.running(counts, "s", ["c"], descending=True).collect()}
    assert all(down[v] == (plain >= v).sum() for v in set(plain))
    ranks = sorted((r["rank"], r.s) for r in M.ranked(df.filter("s is not null"), "s").collect())
    assert [r for r, _ in ranks] == list(range(1, 501)) and [v for _, v in ranks] == sorted(plain)


def test_sequence_kernel_by_loops():
    x, y, k = RNG.normal(size=(3, 4, 2)), RNG.normal(size=(2, 5, 2)), P.Kernel("rbf", gamma=0.3)
    for levels in (1, 2, 3):
        got = R.sequence_gram(x, y, k, levels)
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                g, w = k(p, q), np.ones((4, 5))
                for _ in range(levels - 1):
                    w = np.array([[(1 + sum(g[a, b] * w[a, b] for a in range(s, 4) for b in range(t, 5)) / 20) / 2 for t in range(5)] for s in range(4)])
                assert math.isclose(got[i, j], (1 + (g * w).sum() / 20) / 2)
    own = R.sequence_kernel(x, x, k, 3)
    assert np.allclose(np.diag(own), 1) and np.allclose(own, own.T)


def test_tucker_encodes_new_trajectories(spark):
    time, channel = np.linalg.qr(RNG.normal(size=(12, 3)))[0], np.linalg.qr(RNG.normal(size=(4, 2)))[0]
    make = lambda n: np.einsum("nkm,tk,dm->ntd", RNG.normal(size=(n, 3, 2)), time, channel) + 2.0
    x = make(60)
    model = R.Tucker13.fit(table_of(spark, x.reshape(60, -1)), "v", 4, 3, 2, alpha=0.0)
    assert model.error < 1e-6 and model.time.shape == (12, 3) and model.channel.shape == (4, 2)
    assert model.errors(make(5)).max() < 1e-9 < model.errors(RNG.normal(size=(5, 12, 4)) + 2.0).min()
    shrunk = R.Tucker13.fit(table_of(spark, x.reshape(60, -1)), "v", 4, 3, 2, alpha=1.0)
    rest = (x - x.mean(0)) - (shrunk.decode(shrunk.encode(x)) - shrunk.mean)
    assert math.isclose(shrunk.error, np.linalg.norm(rest) / np.linalg.norm(x - x.mean(0)), rel_tol=1e-6)


@pytest.mark.parametrize("name", Q.METHODS)
def test_every_method_tells_outliers(spark, name):
    x = RNG.normal(size=(80, 8))
    df = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(np.vstack((x, x[:5] + 9)))], "key string, w array<double>")
    fit = Q.METHODS[name](4)
    out = Q.scored(df, fit(df.filter("cast(key as int) < 80"))).toPandas()
    assert len(out) == 85
    far = out.key.astype(int) >= 80
    assert out.score[far].median() > out.score[~far].median()


def test_experiment_takes_any_method(spark):
    rows = [(e, t, float(RNG.normal() + (8 if e % 4 == 0 and t > 20 else 0))) for e in range(48) for t in range(30)]
    s = spark.createDataFrame(rows, "ep long, t long, x double")
    e = E.first_failures(s, (F.col("x") > 5) & (F.col("t") > 22))
    r = experiment.run_experiment(s, e, method="knn", width=3, horizon=2, survival_only=False).metrics.first()
    assert r.n_failed > 0 and r.detection_rate is not None
    rule = Q.oracle_method(lambda x: x[:, 0] > 5, np.array([0.0]), np.array([1.0]))
    told = experiment.run_survival(s, e, ["x"], method=rule, horizon=0)
    assert told.metrics.first().fpr == 0  # survivors never fail


def test_level_sets_and_matches_without_a_cap(spark):
    grid = spark.createDataFrame([(a / 40, b / 40, (a * a + b * b) / 1600.0, (a * a + 2 * b * b) / 1600.0) for a in range(-60, 61) for b in range(-60, 61)], "a double, b double, s double, r double")
    pdf = grid.toPandas()
    p, q = pdf[pdf.s <= 1.01][["a", "b"]].to_numpy(), pdf[pdf.r <= 1.01][["a", "b"]].to_numpy()
    d, outside = X.level_set_distance(grid, ["a", "b"], "s", 1.01, "r", 1.01)
    assert len(p) > 4000 and math.isclose(d, X.hausdorff(p, q), abs_tol=1e-9) and outside == 0
    assert X.level_set_distance(grid, ["a", "b"], "s", -1.0, "r", 1.0)[0] is None


def test_slope_interval_and_tally(spark):
    rows = [(a, a + 1, s, 0.3 * s + float(RNG.normal() * 0.1)) for a in range(40) for s in range(10)]
    r = X.slope_interval(spark.createDataFrame(rows, "a long, b long, s long, log_d double")).first()
    assert r.low < r.slope < r.high and abs(r.slope - 0.3) < 0.02 and r.high - r.low < 0.05
    t = spark.createDataFrame([(1, "m", 0.9), (1, "base", 0.8), (2, "m", 0.8), (2, "base", 0.805), (3, "m", 0.1), (3, "base", 0.5)], "k long, method string, v double")
    assert tuple(M.tally(t, ["k"], "method", "v", "base").first()) == ("m", 1, 1, 1)


def test_disturbances_and_survivors(spark):
    s = spark.createDataFrame([(e, t, float(t)) for e in range(3) for t in range(50)], "ep long, t long, x double")
    noisy = s.select("ep", "t", E.noise("x", 2.0).alias("n"), E.noise("x", 2.0).alias("again"), "x").toPandas()
    assert (noisy.n == noisy.again).all() and 1 < (noisy.n - noisy.x).std() < 3
    force = E.wandering_force(s, 3.0).toPandas().sort_values(["ep", "t"])
    assert force.force.abs().max() <= 3 and force.groupby("ep").force.apply(lambda f: f.autocorr()).mean() > 0.5
    draw = lambda i: spark.createDataFrame([(10 * i + k, 5, 5 if k % 2 else 2) for k in range(10)], "ep long, n_steps long, fail long")
    assert E.collect_survivors(draw, 12).count() == 12
    with pytest.raises(ValueError):
        E.collect_survivors(draw, 50, rounds=3)


def test_sources(spark, tmp_path):
    def bad():
        raise OSError("no such run")

    report = T.rebuild_all(spark, str(tmp_path), {"a/x": lambda: spark.range(3), "a/bad": bad, "a/y": lambda: spark.range(4)})
    assert report["a/x"] is None and report["a/y"] is None and "no such run" in report["a/bad"] and spark.read.parquet(f"{tmp_path}/a/y").count() == 4
    assert T.output_dir("/out/", "scripts/curve.py", "env") == "/out/curve/env" and T.time_call(lambda: spark.range(10), 1, 2) > 0
    for kind in ("blobs", "moons", "spiral", "disc"):
        p = T.make_points(spark, kind, 300, 0.05).toPandas()
        assert len(p) == 300 and np.isfinite(p[["x", "y"]]).all().all()
    disc = T.make_points(spark, "disc", 2000).toPandas()
    radius = np.hypot(disc.x, disc.y)
    assert radius.max() <= 1 and abs((radius < 0.5).mean() - 0.25) < 0.04
    d = np.sqrt(P.squared_distances(x := RNG.normal(size=(20, 2)), x))
    z = R.classical_mds(d, 2)
    assert np.allclose(np.sqrt(P.squared_distances(z, z)), d, atol=1e-6)
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_model_that_grows_too_far_is_an_error(spark, tmp_path):
    from driftloom.streaming import scoring

    spark.createDataFrame([(1, i, [float(i), 0.0]) for i in range(8)], "ep long, t long, v array<double>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ep long, t long, v array<double>").parquet(f"{tmp_path}/in")
    query = scoring.growing_scores(stream, P.Kernel("rbf"), most=5).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/check").start()
    with pytest.raises(Exception, match="beyond 5 points"):
        query.processAllAvailable()


def test_per_step_mmd_and_gram_use_every_episode(spark):
    rng = np.random.default_rng(5)
    rows = [(e, t, float(rng.normal(e % 2, 1))) for e in range(40) for t in range(3)] + [(0, 3, 1.0), (2, 3, None), (1, 4, 0.5), (50, 0, None)]
    s = spark.createDataFrame(rows, "ep long, t long, x double")
    k = P.Kernel("rbf", gamma=0.3)
    got = {r["t"]: r["mmd2"] for r in X.mmd_per_step(s, ["x"], k, F.col("ep") % 2 == 0).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[3] is None and got[4] is None
    for t in range(3):
        a, b = (np.array([[x] for e, u, x in rows if u == t and x is not None and e % 2 == r]) for r in (0, 1))
        gram = lambda p, q: np.exp(-0.3 * (p - q.T) ** 2)
        off = lambda g: (g.sum() - np.trace(g)) / (len(g) * (len(g) - 1))
        assert np.isclose(got[t], off(gram(a, a)) + off(gram(b, b)) - 2 * gram(a, b).mean())
    gram = X.per_step_gram(s, ["x"], k, 2)
    assert gram.select("i").distinct().count() == 40 and gram.select("j").distinct().count() == 2
    assert X.kernel_distance(gram).filter("i = j and d > 1e-6").count() == 0
    empty = s.filter("t < 0")
    assert X.mmd_per_step(empty, ["x"], k, F.col("ep") % 2 == 0).count() == 0 and X.per_step_gram(empty, ["x"], k, 2).count() == 0


def test_spectrum_of_every_run(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=20)
    s = spark.createDataFrame([(3, t, float(v)) for t, v in enumerate(x)] + [(4, t, None if t == 2 else 1.0) for t in range(8)], "ep long, t long, x double")
    got = {(r["ep"], r["k"]): r["mag"] for r in S.spectrum(S.windows(s, 8), "x", 8).collect()}
    assert set(got) == {(300000 + i, k) for i in range(2) for k in range(5)}  # the short rest and the gap have none
    for i in range(2):
        assert np.allclose([got[300000 + i, k] for k in range(5)], np.abs(np.fft.rfft(x[8 * i:8 * i + 8])))
    assert S.spectrum(S.windows(s.filter("t < 0"), 8), "x", 8).count() == 0


def test_convolution_counts_are_whole_and_their_kernel_is_that_of_shares():
    from driftloom.operators import trajectory_kernels as K
    from driftloom.operators.sequences import KERNELS

    rng = np.random.default_rng(21)
    for length in (5, 60):
        x = rng.exponential(size=(40, length, 1))
        counts, shares = K.convolution_counts(x)(x), K.convolution_map(x)(x)
        assert counts.dtype == (np.float32 if length == 5 else float) and (counts == np.round(counts)).all() and (counts / length == shares).all() | (length == 5)
        want = np.square(shares[:, None] - shares[None]).sum(2) * length**2
        got = P.squared_distances(counts, counts)
        assert got.dtype == float and (got == np.round(want)).all() and np.allclose(got, want, atol=1e-6)
    assert KERNELS["minirocket"].features is K.convolution_counts


def test_windows_are_scored_by_all_tasks(spark):
    windows = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.array(F.col("id").cast("double")).alias("w")).coalesce(1)
    tasks = Q.scored(windows, lambda x: x[:, 0]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()
    assert len(tasks) >= 4 and max(r.n for r in tasks) < 400 and sum(r.s for r in tasks) == 999 * 500


def direct_sequence_score(x, z, width, gamma, lam=1e-7):
    kernel = Q.SequenceKernel(width, P.Kernel("rbf", gamma=gamma))
    half = np.linalg.inv(np.linalg.cholesky(kernel(x, x) + lam * len(x) * np.eye(len(x))))
    return 1 - ((kernel(z, x) @ half.T) ** 2).sum(1)


@pytest.mark.parametrize("channels", [1, 2])
def test_sequence_method_is_fitted_on_all_windows(spark, monkeypatch, channels):
    rng = np.random.default_rng(22)
    n = 1300 if channels == 1 else 60  # more than a fit set of old
    x, z = np.round(rng.exponential(size=(n, 3 * channels)), 2), np.vstack((rng.exponential(size=(30, 3 * channels)), np.full((1, 3 * channels), 60.0), np.full((1, 3 * channels), -9.0)))
    windows = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "key string, w array<double>").repartition(3)
    gamma = R.per_step_gamma(x.reshape(n, 3, channels))
    assert abs(Q.steps_gamma(windows, 3) / gamma - 1) < 1e-12
    want = direct_sequence_score(x, z, 3, gamma)
    assert np.allclose(Q.sequence_method(3)(windows)(z), want, rtol=1e-4, atol=1e-6)
    if channels == 1:  # pivots of all windows, where features would be too many
        some, few = windows.filter("cast(key as int) < 60"), x[:60]
        monkeypatch.setattr(Q, "SEQUENCE_FEATURES", 1)
        monkeypatch.setattr(Q, "HELD_VALUES", 1)
        assert np.allclose(Q.sequence_method(3)(some)(z), direct_sequence_score(few, z, 3, R.per_step_gamma(few[:, :, None])), rtol=1e-4, atol=1e-6)
    assert (Q.sequence_method(3)(windows.limit(0))(z) == 1).all()


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_sequence_features_make_the_kernel(levels):
    x, static = RNG.normal(size=(20, 4)), P.Kernel("rbf", gamma=0.7)
    wave = R.waves(x.min(), x.max(), 0.7)
    assert np.allclose(wave(np.array([50.0, -50.0])) @ wave(x.ravel()).T, 0, atol=1e-12)
    few = x[:, :, None] * 0.2
    f = R.waves(few.min(), few.max(), 0.7, 1e-9)(few[:, :, 0])
    got = R.sequence_features(f, levels)
    assert np.allclose(got @ got.T, R.sequence_gram(few, few, static, levels), atol=1e-8)
    assert np.allclose(R.sequence_own(few, static, levels), np.diag(got @ got.T), atol=1e-8)
