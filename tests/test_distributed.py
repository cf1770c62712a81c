"""Factorizations, selection, resampling, scans and matching over whole tables, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import bases as B
from driftloom.operators import detectors as D
from driftloom.operators import factorizations as FA
from driftloom.operators import matching as X
from driftloom.operators import pairs as P
from driftloom.operators import resampling as U
from driftloom.operators import scans as SC
from driftloom.operators import windows as W


def points(spark, x, parts=5, **more):
    rows = [(i, [float(v) for v in r], *[c[i] for c in more.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["k long", "v array<double>", *[f"{c} int" for c in more]])).repartition(parts)


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(0).normal(size=(220, 3))


# tall QR


def test_tall_qr_equals_a_local_one(spark, cloud):
    df = points(spark, cloud, 23).unionByName(spark.createDataFrame([(900, None)], "k long, v array<double>"))
    phi = lambda x: B.features_np(x, 2, "monomial")
    for fan in (2, 8):
        n, r = FA.tall_qr(df, "v", phi, fan)
        want = np.linalg.qr(phi(cloud), mode="r")
        want *= np.sign(np.diag(want))[:, None]
        assert n == 220 and np.allclose(r, want) and (np.diag(r) >= 0).all()
    assert FA.tall_qr(df.limit(0), "v") [0] == 0
    n, r = FA.tall_qr(points(spark, cloud[:4], 2), "v", lambda x: np.hstack((x, x * x)))  # fewer rows than columns
    assert n == 4 and np.allclose(r.T @ r, (p := np.hstack((cloud[:4], cloud[:4] ** 2))).T @ p)


def test_qr_scores_hold_where_the_moment_matrix_fails(spark, cloud):
    far = 1e4 + cloud  # monomials of a shifted cloud: scores don't change under shifts, the condition does
    names = ["a", "b", "c"]
    frame = lambda x: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    near, shifted = frame(cloud), frame(far)
    want = {r["k"]: r["score"] for r in D.CDPolynomial.fit(near, names, 2).score(near).collect()}
    exact = {r["k"]: r["score"] for r in D.CDPolynomial.fit(near, names, 2, method="qr").score(near).collect()}
    assert all(abs(exact[k] / want[k] - 1) < 1e-9 for k in want)
    phi = B.features_np(far, 2, "monomial")
    assert np.linalg.cond(phi) > 1e8 and np.linalg.cond(phi.T @ phi) > 1e15
    held = {r["k"]: r["score"] for r in D.CDPolynomial.fit(shifted, names, 2, method="qr").score(shifted).collect()}
    assert all(abs(held[k] / want[k] - 1) < 1e-3 for k in want)
    odd = shifted.unionByName(spark.createDataFrame([(999, None, 1.0, 1.0)], near.schema))
    assert [r["score"] for r in D.CDPolynomial.fit(odd, names, 2, method="qr").score(odd).filter("k = 999").collect()] == [None]


def test_wide_polynomials_go_by_blocks(spark, monkeypatch, cloud):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cloud)], "k long, a double, b double, c double")
    want = {r["k"]: r["score"] for r in D.CDPolynomial.fit(df, ["a", "b", "c"], 2).score(df).collect()}
    monkeypatch.setattr(D, "COLUMNS", 3)
    got = {r["k"]: r["score"] for r in D.CDPolynomial.fit(df, ["a", "b", "c"], 2).score(df).collect()}
    assert all(abs(got[k] - want[k]) < 1e-8 * want[k] for k in want)


# pivoted Cholesky


@pytest.mark.parametrize("batch", [1, 8, 64])
def test_greedy_pivots_equal_the_sequential_ones(spark, cloud, batch):
    kernel = P.Kernel("rbf", gamma=0.3)
    f, pivots = D.pivoted_cholesky(kernel, cloud, 30, pivot="greedy")
    got = FA.pivoted_cholesky_all(points(spark, cloud), "v", "k", kernel, 30, batch=batch)
    assert got.keys == pivots and got.sweeps == 30 if batch == 1 else got.sweeps < 30
    table = got.table.toPandas().sort_values("k")
    mine = np.array(table["f"].tolist())
    assert np.allclose(mine, f) and np.allclose(table["d"], np.maximum(1 - (f * f).sum(1), 0), atol=1e-9)
    assert np.allclose(got.triangle, f[pivots], atol=1e-9)


@pytest.mark.parametrize("pivot", ["rp", "uniform"])
def test_other_pivots_factor_the_matrix(spark, cloud, pivot):
    kernel = P.Kernel("rbf", gamma=0.3)
    got = FA.pivoted_cholesky_all(points(spark, cloud), "v", "k", kernel, 40, pivot=pivot, seed=3)
    assert len(got.keys) == len(set(got.keys)) == 40
    mine = np.array(got.table.toPandas().sort_values("k")["f"].tolist())
    gram = kernel(cloud, cloud)
    x = cloud[got.keys]
    best = gram - kernel(cloud, x) @ np.linalg.inv(kernel(x, x)) @ kernel(x, cloud)
    assert np.allclose(gram - mine @ mine.T, best, atol=1e-6)


def test_pivots_end_with_the_rank_of_the_data(spark):
    x = np.repeat(np.eye(3), 20, axis=0)
    got = FA.pivoted_cholesky_all(points(spark, x), "v", "k", P.Kernel("linear", c=0.0), 10)
    assert len(got.keys) == 3 and got.keys == [0, 20, 40]
    assert FA.pivoted_cholesky_all(points(spark, x).limit(0), "v", "k", P.Kernel("rbf"), 3).keys == []


def test_random_pivots_follow_the_residuals(spark):
    x = np.concatenate((np.zeros((60, 2)), np.random.default_rng(1).normal(size=(60, 2)) * 9))
    first = [FA.pivoted_cholesky_all(points(spark, x, 2), "v", "k", P.Kernel("rbf", gamma=1.0), 4, pivot="rp", seed=s).keys for s in range(12)]
    assert all(sum(k < 60 for k in keys) <= 1 for keys in first)  # one of the sixty equal rows takes all their residuals
    assert len({tuple(k) for k in first}) > 6


def test_low_rank_score_of_all_rows_equals_the_fit_set(spark, cloud):
    kernel = P.Kernel("rbf", gamma=0.3)
    a = D.KernCD.fit_all(points(spark, cloud), "v", "k", kernel, 25, 1e-3)
    b = D.KernCD.fit_points(cloud, kernel, 1e-3, rank=25, pivot="greedy")
    y = np.random.default_rng(2).normal(size=(30, 3)) * 2
    assert np.allclose(a.score_points(y), b.score_points(y), atol=1e-7)
    full, exact = D.KernCD.fit_all(points(spark, cloud), "v", "k", kernel, 220, 1e-3), D.KernCD.fit_points(cloud, kernel, 1e-3)
    assert np.allclose(full.score_points(y), exact.score_points(y), atol=1e-4)


def test_decade_ridge_brings_the_condition_down():
    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(60, 2 + seed))
        gram = P.Kernel("rbf", gamma=P.bandwidth(x, "rbf", "median"))(x, x)
        lam = D.decade_ridge(gram)
        assert np.linalg.cond(gram + lam * 60 * np.eye(60)) < 1e3 <= np.linalg.cond(gram + lam / 10 * 60 * np.eye(60))
    assert D.decade_ridge(np.eye(5)) == 1e-14


# selection among all pairs


@pytest.mark.parametrize("n", [2, 3, 41, 220])
def test_median_of_pairs_is_exact(spark, monkeypatch, cloud, n):
    x = np.vstack((cloud[:n], cloud[:2]))  # two repeated points: distances of 0 don't count
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(len(x), 1)]
    df = points(spark, x)
    assert abs(P.median_of_pairs(df, "v", "k") - np.median(d[d > 0])) < 1e-12
    monkeypatch.setattr(P, "PARTS", 8)
    monkeypatch.setattr(P, "FEW_DISTANCES", 5)  # several passes
    monkeypatch.setattr(P.meet, "__defaults__", (7,))  # blocks of seven rows
    if n < 100:
        assert abs(P.median_of_pairs(df, "v", "k") - np.median(d[d > 0])) < 1e-12


def test_median_of_few_or_equal_points(spark):
    same = points(spark, np.ones((6, 2)))
    assert P.median_of_pairs(same, "v", "k") is None and P.median_of_pairs(same.limit(0), "v", "k") is None
    grid = points(spark, np.array([[0.0], [1.0], [2.0], [3.0]]))  # distances 1 1 1 2 2 3
    assert P.median_of_pairs(grid, "v", "k") == 1.5
    x = np.random.default_rng(3).normal(size=(50, 2))
    assert abs(P.bandwidth_of_all(points(spark, x), "v", "k", "rbf") - P.bandwidth(x, "rbf", "median")) < 1e-9
    assert abs(P.bandwidth_of_all(points(spark, x), "v", "k", "abel", "median_5nn") - P.bandwidth(x, "abel", "median_5nn")) < 1e-9


# resampling


def test_thresholds_take_exactly_so_many(spark):
    df = points(spark, np.zeros((500, 1)), g=[i % 2 for i in range(500)])
    limits = U.hash_thresholds(df, "k", "g", {1: 40, 0: 7}, 6, 5)
    for g, n in ((1, 40), (0, 7)):
        for r in range(6):
            assert df.filter((F.col("g") == g) & (F.xxhash64(F.col("k"), F.lit(5), F.lit(r)) <= limits[g][r])).count() == n
    assert len({limits[1][r] for r in range(6)}) == 6


def test_permutation_test_against_a_plain_one(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 2)), (np.arange(300) < 120).astype(int)
    x[y == 1] += 0.25
    kernel = P.Kernel("rbf", gamma=0.5)
    g = kernel(x, x)
    np.fill_diagonal(g, 0)

    def mmd(y):
        a, b = y.sum(), (1 - y).sum()
        return y @ g @ y / (a * (a - 1)) + (1 - y) @ g @ (1 - y) / (b * (b - 1)) - 2 * y @ g @ (1 - y) / (a * b)

    null = np.array([mmd(rng.permutation(y)) for _ in range(2000)])
    row = U.mmd_permutation(points(spark, x, y=[int(v) for v in y]), "v", "k", F.col("y") == 1, kernel, 300, 1).first()
    assert abs(row["mmd2"] - mmd(y)) < 1e-12 and abs(row["null_sd"] / null.std() - 1) < 0.15
    assert abs(row["null_mean"] - null.mean()) < 4 * null.std() / math.sqrt(300)
    assert abs(row["z"] - (mmd(y) - null.mean()) / null.std()) < 0.2 * abs(row["z"]) + 0.3
    both = U.mmd_interval(points(spark, x, y=[int(v) for v in y]), "v", "k", F.col("y") == 1, kernel, 100, 1).first()
    assert both["z_low"] < both["z"] * 1.3 and both["z_low"] < both["z_high"]
    one = U.mmd_permutation(points(spark, x[:5], y=[1, 0, 0, 0, 0]), "v", "k", F.col("y") == 1, kernel, 5).first()
    assert one["mmd2"] is None


def test_bootstrap_of_all_rows(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(3000) < 0.2).astype(int)
    s = np.round(rng.normal(size=3000) + 0.6 * y, 2)

    def auroc(y, s):
        order = np.argsort(s, kind="stable")
        _, first, counts = np.unique(s[order], return_index=True, return_counts=True)
        rank = np.empty(len(s))
        rank[order] = np.repeat(first + (counts + 1) / 2, counts)
        return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())

    draws = [rng.integers(0, 3000, 3000) for _ in range(1500)]
    se = np.std([auroc(y[i], s[i]) for i in draws])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double").repartition(6)
    row = U.bootstrap_auroc(df, replicates=800, seed=2).first()
    assert abs(row["estimate"] - auroc(y, s)) < 1e-12 and abs(row["se"] / se - 1) < 0.1 and row["replicates"] == 800
    assert U.bootstrap_auroc(df, replicates=5).first()["se"] == U.bootstrap_auroc(df.repartition(2), replicates=5).first()["se"]
    assert U.bootstrap_auroc(df.filter("label = 1"), replicates=5).first()["replicates"] == 0


# scans


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_scan_equals_the_recursion(spark, block):
    rng = np.random.default_rng(6)
    rows = [(e, int(t), float(rng.uniform(-1, 1)), float(rng.normal())) for e, n in ((1, 90), (2, 1), (3, 33)) for t in np.sort(rng.choice(400, n, False))]
    want = {}
    for e, t, a, b in rows:
        want[e, t] = a * want.get((e, "y"), 0.0) + b
        want[e, "y"] = want[e, t]
    df = spark.createDataFrame(rows, "ep long, t long, a double, b double").repartition(4)
    got = SC.affine_scan(df, ["ep"], "t", block).collect()
    assert len(got) == len(rows) and all(abs(r["y"] - want[r["ep"], r["t"]]) < 1e-12 for r in got)
    assert SC.affine_scan(df.limit(0), ["ep"], "t", block).count() == 0


def test_low_pass_keeps_steps_and_skips_gaps(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 6, None), (1, 7, 4.0)], "ep long, t long, x double")
    got = {r["t"]: r["y"] for r in W.low_pass(df, "x", 0.5).collect()}
    assert got == {5: 1.0, 6: None, 7: 2.5}


# neighbours without a cap


def test_neighbours_beyond_the_former_cap(spark):
    x = np.random.default_rng(7).normal(size=(4300, 2))
    df = points(spark, x)
    near = {r["k"]: r["score"] for r in D.KNN.fit(df, "v", "k", 1).score(points(spark, x[:50] + 1e-3).withColumn("k", F.col("k") + 10_000)).collect()}
    assert max(near.values()) < 2e-3  # every row is among the fitted ones
    model = D.LinearReconstruction.fit(df, "v", 1)
    cov = np.cov(x.T, bias=True)
    assert abs(abs(model.directions[0] @ np.linalg.eigh(cov)[1][:, -1]) - 1) < 1e-9


# matched neighbours in a window


def test_matched_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    sizes = {e: int(rng.integers(12, 30)) for e in range(12)}
    rows = [(e, t, float(rng.normal()), float(rng.normal())) for e, n in sizes.items() for t in range(n)]
    params = {e: float(rng.uniform(0, 5)) for e in sizes}
    states = spark.createDataFrame(rows, "ep long, t long, x double, y double").repartition(3)
    eps = spark.createDataFrame([(e, sizes[e], p) for e, p in params.items()], "ep long, n_steps long, p double")
    at = {(e, t): np.array([x, y]) for e, t, x, y in rows}
    want = {}
    for (e, t), v in at.items():
        if 2 <= t < sizes[e] - 4:
            found = [(float(((v - w) ** 2).sum()), f, u) for (f, u), w in at.items() if f != e and abs(params[e] - params[f]) <= 1.0 and abs(t - u) <= 3 and 2 <= u < sizes[f] - 4]
            if found:
                want[e, t] = min(found)
    got = X.matched_neighbours(states, eps, ["x", "y"], ["p"], [1.0], 3, 2, 4).collect()
    assert {(r["ep"], r["t"]): (r["match"], r["match_t"]) for r in got} == {k: v[1:] for k, v in want.items()}
    curves = X.matched_curves(states, X.matched_neighbours(states, eps, ["x", "y"], ["p"], [1.0], 3, 2, 4), ["x", "y"], 4).collect()
    assert len(curves) == 5 * len(want)
    for r in curves:
        e, t = map(int, r["a"].split(":"))
        _, f, u = want[e, t]
        assert f == r["b"] and abs(r["log_d"] - math.log(np.linalg.norm(at[e, t + r["s"]] - at[f, u + r["s"]]) + 1e-12)) < 1e-9
    assert X.matched_neighbours(states, eps, ["x", "y"], ["p"], [1.0], 3, 2, 4, anchors=9).count() <= 9


# window kernels


def test_scattering_bank_adds_no_energy():
    from driftloom.operators.trajectory_kernels import Scattering

    for length, octaves, per in ((30, 6, 1), (64, 3, 1), (100, 5, 4)):
        s = Scattering(length, octaves, per)
        assert 2 ** s.octaves <= length and len(s.first) == s.octaves * per
        for bank in (s.first, s.second):
            e = s.energy(bank)
            assert e.max() <= 1 + 1e-9 and e[np.abs(np.fft.fftfreq(s.size)) < 0.35].min() > 0.2
            assert all(abs(b[0]) < 1e-12 for _, b in bank)
        x = np.random.default_rng(9).normal(size=(7, length, 3))
        f = s(x)
        paths = 1 + len(s.first) + sum(lo < c for c, _ in s.first for lo, _ in s.second)
        assert f.shape == (7, 3 * paths) and np.allclose(s(x[:, :, 1:2]), f[:, paths:2 * paths])
        assert np.allclose(s(x + 5)[:, 1:paths], f[:, 1:paths])  # only the mean sees a constant
    s = Scattering(64, 4, order=1)
    t = np.arange(64)
    fast, slow = (s(np.sin(2 * np.pi * w * t)[None, :, None])[0, 1:5] for w in (0.3, 0.05))
    assert fast.argmax() < slow.argmax()


def test_convolutions_have_all_features_and_see_all_channels():
    from driftloom.operators.trajectory_kernels import convolution_map

    x = np.random.default_rng(10).normal(size=(40, 30, 3))
    f = convolution_map(x, 9996)
    a = f(x)
    assert a.shape == (40, 9996) and a.min() >= 0 and a.max() <= 1 and 0.3 < a.mean() < 0.7
    assert np.allclose(f(x[:5]), a[:5]) and np.allclose(convolution_map(x, 9996)(x), a)
    for k in range(3):
        other = x.copy()
        other[:, :, k] = -other[:, ::-1, k]
        assert np.abs(f(other) - a).max() > 0.1


def test_spatiotemporal_equals_the_double_sum():
    from driftloom.operators import trajectory_kernels as K

    rng = np.random.default_rng(11)
    x, y, t = rng.normal(size=(5, 6, 2)), rng.normal(size=(4, 6, 2)), K.TemporalKernel.of("rbf", 2.0).matrix(np.arange(6.0))
    k = P.Kernel("rbf", gamma=0.5)
    assert np.allclose(K.spatiotemporal(x, y, t, k), [[(t * k(p, q)).sum() for q in y] for p in x])


def test_twelve_methods_are_named():
    from driftloom.operators.sequences import METHODS

    assert set(METHODS) == {"fft", "sig", "scatter", "minirocket", "rbf", "abel", "conv_ae", "gaussian", "cd_poly_d2", "cd_poly_d3", "cd_poly_d4", "knn"}


# reductions


def test_bilinear_encoder_against_explicit_sums(spark):
    from driftloom.operators.reduction import BilinearEncoder

    rng = np.random.default_rng(12)
    x = np.einsum("nk,tk,dk->ntd", rng.normal(size=(40, 4)), np.cumsum(rng.normal(size=(15, 4)), 0), rng.normal(size=(5, 4))) + 0.3 * rng.normal(size=(40, 15, 5)) + 1.0
    df, basis = points(spark, x.reshape(40, -1), 6), B.temporal_matrix("bspline", 15, 5)
    h = B.encoder(basis)
    for strategy in ("space_first", "time_first", "joint"):
        e = BilinearEncoder.fit(df, "v", basis, 2, strategy)
        assert np.allclose(e.directions.T @ e.directions, np.eye(2), atol=1e-9)
        assert abs(e.error - np.linalg.norm(x - e.decode(e.encode(x))) / np.linalg.norm(x)) < 1e-8
        rows = (x if strategy == "space_first" else np.einsum("kt,ntd->nkd", h, x)).reshape(-1, 5)
        if strategy != "joint":
            s = np.linalg.svd(rows - rows.mean(0), full_matrices=False)[2][:2].T
            assert np.allclose(np.abs(np.linalg.svd(s.T @ e.directions)[1]), 1, atol=1e-6)
    assert all(a >= b - 1e-12 for a, b in zip(e.errors, e.errors[1:])) and len(e.errors) > 2
    assert BilinearEncoder.fit(df, "v", basis, None, "space_first").directions.shape == (5, 5)
    shares = [BilinearEncoder.fit(df, "v", basis, v, "time_first").directions.shape[1] for v in (0.3, 0.9, 0.999)]
    assert shares == sorted(shares) and shares[0] < shares[-1]
    with pytest.raises(ValueError):
        BilinearEncoder.fit(df, "v", basis, 0.9, "joint")


def test_landmark_mds_places_every_row(spark):
    from driftloom.operators.reduction import classical_mds, landmark_mds

    x = np.random.default_rng(13).normal(size=(90, 2)) * [3, 1]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for landmarks in (90, 30):  # points of a plane lie where they are, whatever the landmarks
        rows = landmark_mds(points(spark, x), "v", "k", 2, landmarks).orderBy("k").collect()
        z = np.array([r["z"] for r in rows])
        assert np.allclose(np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), d, atol=1e-6)
    y = np.random.default_rng(14).normal(size=(60, 6))
    z = np.array([r["z"] for r in landmark_mds(points(spark, y), "v", "k", 2, 60).orderBy("k").collect()])
    want = classical_mds(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), 2)
    assert np.allclose(np.abs(z), np.abs(want), atol=1e-6)


# streams


def run_stream(spark, tmp_path, made, batches, name):
    """All rows that a stream over the batches gives, a file a micro-batch."""
    src, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(src)
    frame = made(spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return spark.read.schema(frame.schema).parquet(out).collect()


def test_streams_take_steps_out_of_order(spark, tmp_path):
    from driftloom.streaming import scoring as X

    rng = np.random.default_rng(15)
    values = {e: rng.normal(size=n) for e, n in ((1, 14), (2, 9), (3, 2))}
    rows = [(e, t, float(x)) for e, xs in values.items() for t, x in enumerate(xs)]
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    schema = "ep long, t long, x double"
    batches = [spark.createDataFrame(part, schema) for part in (mixed[:9], mixed[9:17] + mixed[:2], mixed[17:])]  # two rows come twice
    got = run_stream(spark, tmp_path, lambda s: X.windowed_scores(s, 3, lambda w: float(w.mean()), 0.5), batches, "held")
    want, alarms = {}, {}
    for e, xs in values.items():
        for t in range(2, len(xs)):
            want[e, t] = xs[t - 2:t + 1].mean()
            if want[e, t] > 0.5:
                alarms.setdefault(e, t)
    assert {(r["ep"], r["end"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        first = alarms.get(r["ep"], 10**9)
        assert abs(r["score"] - want[r["ep"], r["end"]]) < 1e-12 and r["first_alarm"] == (first if first <= r["end"] else -1)
    sums = run_stream(spark, tmp_path, lambda s: X.cusum(s, 0.1, 1.0), batches, "sums")
    level = {}
    for e, t, x in rows:
        level[e, t] = max(0.0, level.get((e, t - 1), 0.0) + x - 0.1)
    assert {(r["ep"], r["t"]): round(r["level"], 9) for r in sums} == {k: round(v, 9) for k, v in level.items()}


def test_missing_steps_are_given_up(spark, tmp_path):
    from driftloom.streaming import scoring as X

    first = spark.createDataFrame([(1, t, 1.0) for t in (0, 1, 2, 4, 5, 6, 7)], "ep long, t long, x double")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    frame = X.windowed_scores(stream, 3, lambda w: float(w.sum()), 99.0, patience=1)
    q = frame.writeStream.format("memory").queryName("given_up").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(40):  # timers keep the stream busy, so it is never done
            q.awaitTermination(1)
            ends = sorted(r["end"] for r in spark.table("given_up").collect())
            if len(ends) == 3:
                break
    finally:
        q.stop()
    assert ends == [2, 6, 7]


def test_growing_models_equal_refits(spark, tmp_path):
    from driftloom.streaming import scoring as X

    rng = np.random.default_rng(16)
    rows = [(e, t, rng.normal(size=2).tolist()) for t in range(8) for e in (1, 2)]
    schema = "ep long, t long, v array<double>"
    kernel = P.Kernel("rbf", gamma=0.5)
    got = run_stream(spark, tmp_path, lambda s: X.growing_scores(s, kernel, 1e-2), [spark.createDataFrame(rows[:5], schema), spark.createDataFrame(rows[5:], schema)], "growing")
    assert len(got) == 16
    for e in (1, 2):
        model, mine = None, sorted((r for r in got if r["ep"] == e), key=lambda r: r["t"])
        for r, (_, _, v) in zip(mine, [x for x in rows if x[0] == e]):
            x = np.array([v])
            assert abs(r["score"] - (model.score_points(x)[0] if model else 1.0)) < 1e-9
            model = model.update(x[0]) if model else D.KernCD.fit_points(x, kernel, 1e-2)


# centres and moments of all rows, several quantiles, curves


def test_farthest_points_of_all_rows(spark, cloud):
    from driftloom.operators.reduction import farthest_points, farthest_points_all

    keys, centres, fill = farthest_points_all(points(spark, cloud), "v", "k", 9)
    want, reach = farthest_points(cloud, 9)
    assert keys == want and np.allclose(centres, cloud[want]) and abs(fill - reach) < 1e-9
    few = points(spark, np.repeat(np.eye(2), 3, axis=0))
    assert farthest_points_all(few, "v", "k", 5)[0] == [0, 3] and farthest_points_all(few.limit(0), "v", "k", 5)[0] == []


def test_smoothed_moments_of_all_rows(spark, cloud):
    from driftloom.operators.volume import smoothed_moments, smoothed_moments_all

    df = spark.createDataFrame([(float(a), float(b)) for a, b, _ in cloud] + [(None, 1.0)], "a double, b double")
    for shape in ("gauss", "ball"):
        for mean in (True, False):
            assert np.allclose(smoothed_moments_all(df, ["a", "b"], 2, 0.3, shape, mean), smoothed_moments(cloud[:, :2], 2, 0.3, shape, mean))


def test_quantiles_of_several_columns(spark):
    from driftloom.operators.metrics import quantiles, quantiles_of

    rng = np.random.default_rng(17)
    a, b = rng.normal(size=3001), rng.integers(0, 7, 3001).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, 3.0, None)], "a double, b double, c double")
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    for n in (4, 256):
        got = quantiles_of(df, ["a", "b", "c"], shares, n)
        assert np.allclose(got["a"], np.quantile(a, shares)) and np.allclose(got["b"], np.quantile(np.append(b, 3.0), shares)) and got["c"] == [None] * 6
    assert quantiles(df.limit(0), "a", [0.5]) == [None]


def test_curves_at_the_ends(spark):
    from driftloom.operators.metrics import pr_auc, tpr_at_fpr

    rng = np.random.default_rng(18)
    y = (rng.random(400) < 0.3).astype(int)
    s = np.round(rng.normal(size=400) + y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    cuts = np.sort(np.unique(s))[::-1]
    tpr, fpr, prec = (np.array([f(s >= c) for c in cuts]) for f in (lambda h: h[y == 1].mean(), lambda h: h[y == 0].mean(), lambda h: y[h].mean()))
    for at in (0.0, 0.05, 0.3, float(fpr[5]), 1.0):
        x, v = np.append(0, fpr), np.append(0, tpr)
        exact = v[x == at]
        below, above = max(i for i in range(len(x)) if x[i] < at) if at > 0 else 0, next((i for i in range(len(x)) if x[i] >= at), len(x) - 1)
        want = exact.max() if len(exact) else v[below] + (v[above] - v[below]) * (at - x[below]) / (x[above] - x[below])
        assert abs(tpr_at_fpr(df, at).first()["tpr"] - want) < 1e-9
    area = sum((t - t0) * (p + p0) / 2 for t, t0, p, p0 in zip(tpr, np.append(0, tpr), prec, np.append(1, prec)))
    assert abs(pr_auc(df).first()["pr_auc"] - area) < 1e-9


def test_splits_are_normalized_by_train(spark, tmp_path):
    from driftloom.sources import tables as T

    states = spark.createDataFrame([(e, t, float(e + t)) for e in range(40) for t in range(5)], "ep long, t long, x double")
    episodes = spark.createDataFrame([(e, 5 if e % 4 else 3, 5) for e in range(40)], "ep long, fail long, n_steps long")
    T.save(states, str(tmp_path), "toy", "d")
    T.save(episodes, str(tmp_path), "toy", "d_episodes")
    got = T.load_splits(spark, str(tmp_path), "toy/d", {"train": 0.5, "test": 0.5}, ("train",), channels=["x"])
    train, test = got["train"], got["test"]
    row = train[0].agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 1) < 1e-9
    assert train[1].filter("fail < n_steps").count() == 0 and test[1].filter("fail < n_steps").count() == 10
    assert {r["ep"] for r in train[0].select("ep").distinct().collect()} == {r["ep"] for r in train[1].collect()}
    with pytest.raises(ValueError):
        T.split_and_normalize(states, episodes, ["x"], {"a": 1.0})
    with pytest.raises(ValueError):
        W.sliding(states, ["x"], 6, strict=True)
