"""Meeting of all rows: copies, memory and results, whatever the number of blocks."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import pairs as P


def points(spark, x, **more):
    rows = [(i, [float(v) for v in r], *[c[i] for c in more.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["k long", "v array<double>", *[f"{c} int" for c in more]])).repartition(3)


def test_sides_are_cut_into_a_bounded_number_of_blocks(spark, monkeypatch):
    import pandas as pd

    df = points(spark, np.random.default_rng(0).normal(size=(100, 2)))
    monkeypatch.setattr(P.meet, "__defaults__", (5,))  # twenty blocks of five rows
    monkeypatch.setattr(P, "SIDE", 3)
    met = lambda **kw: P.meet(df, df, "v", "k", lambda p, x, q, y: pd.DataFrame({"n": [len(x)], "m": [len(y)]}), "n long, m long", **kw).toPandas()
    assert len(met()) == 9 and len(met(once=True)) == 6
    assert (all_pairs := met())["n"].mul(all_pairs["m"]).sum() == 100 * 100
    monkeypatch.setattr(P, "HELD_ROWS", 10)
    assert len(met()) == 100


def test_copies_of_a_row_do_not_grow_with_the_table(spark):
    import pandas as pd

    pairs = lambda n: P.meet(df := spark.range(n).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("v")), df, "v", "k", lambda p, x, q, y: pd.DataFrame({"n": [len(x)]}), "n long", once=True).count()
    assert pairs(8_000) == pairs(80_000) == 36


def test_laplace_kernel_lays_out_no_differences(monkeypatch):
    a, b = np.random.default_rng(1).normal(size=(2, 300, 64))
    want = np.exp(-0.2 * np.abs(a[:, None, :] - b[None, :, :]).sum(2))
    tracemalloc.start()
    got = P.Kernel("laplace", gamma=0.2)(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, rtol=1e-12) and peak < 8 * got.nbytes  # 64 times that with all differences


@pytest.mark.parametrize("size", [4, 2000])
def test_both_rows_of_a_pair_get_its_value(spark, monkeypatch, size):
    x = np.random.default_rng(2).normal(size=(30, 3))
    x[20:] = x[:10]  # copies
    y = (np.arange(30) % 3 > 0).astype(int)
    df, other = points(spark, x, y=y.tolist()), points(spark, x, y=y.tolist())
    monkeypatch.setattr(P.meet, "__defaults__", (size,))
    monkeypatch.setattr(P, "TILE", 3)
    kernel = P.Kernel("rbf", gamma=0.3)
    gram, d = kernel(x, x), np.sqrt(np.square(x[:, None] - x[None]).sum(2))
    for fitted in (df, other):
        assert np.allclose([r.k_mean for r in P.gram_all(df, fitted, "v", "k", kernel).orderBy("k").collect()], gram.mean(1))
        near = P.knn_all(df, fitted, "v", "k", 4, skip_self=True).orderBy("k").collect()
        want = np.sort(np.where(np.eye(30) > 0, np.inf, d), axis=1)[:, :4]
        assert np.allclose([(r.score, r.kth, r.nearest) for r in near], np.stack((want.mean(1), want[:, 3], want[:, 0]), axis=1), atol=1e-12)
    off, a = gram - np.diag(np.diag(gram)), y == 1
    mmd = lambda a, off: off[a][:, a].sum() / (a.sum() * (a.sum() - 1)) + off[~a][:, ~a].sum() / ((~a).sum() * ((~a).sum() - 1)) - 2 * off[a][:, ~a].mean()
    assert abs(P.mmd2(df, "v", "k", F.col("y") == 1, kernel).first()[0] - mmd(a, off)) < 1e-12
    parts = {r.g: r.mmd2 for r in P.mmd2(df.withColumn("g", F.col("k") % 2), "v", "k", F.col("y") == 1, kernel, by=["g"]).collect()}
    for g in (0, 1):
        at = np.arange(30) % 2 == g
        assert abs(parts[g] - mmd(a[at], off[at][:, at])) < 1e-12


@pytest.mark.parametrize("kernel", [P.Kernel("poly", gamma=0.5, c=c, degree=degree) for c, degree in ((1.0, 3), (-0.7, 4), (0.0, 1))] + [P.Kernel("linear", c=1.0), P.Kernel("polyfft", degree=2)], ids=str)
def test_powers_of_dot_products_lay_out_no_pairs(spark, monkeypatch, kernel):
    x, y = np.random.default_rng(4).normal(size=(2, 700, 5))
    df, other = points(spark, x), points(spark, y[:300])
    means = lambda fitted: P.gram_all(df, fitted, "v", "k", kernel).orderBy("k").collect()
    want = {id(df): kernel(x, x).mean(1), id(other): kernel(x, y[:300]).mean(1)}
    with monkeypatch.context() as m:
        m.setattr(P, "meet", None)
        for fitted in (df, other):
            got = means(fitted)
            assert np.allclose([r.k_mean for r in got], want[id(fitted)], rtol=1e-10, atol=1e-10) and np.allclose([r.k_self for r in got], kernel.diag(x))
    monkeypatch.setattr(P, "MOMENTS", 1)  # too few for any of them: all rows meet
    assert np.allclose([r.k_mean for r in means(df)], want[id(df)]) and not means(other.limit(0))
    monkeypatch.undo()
    assert not means(other.limit(0))


def test_scores_are_made_of_bounded_blocks(spark, tmp_path):
    from driftloom.operators import detectors as D

    x = np.random.default_rng(3).normal(size=(1500, 2))
    df = points(spark, x).coalesce(1)
    rows = D._score_blocks(df, "v", lambda b: np.full(len(b), float(len(b)))).collect()
    assert len(rows) == 1500 and max(r.score for r in rows) <= 256
    met = P.against(df, "v", "k", lambda k, b: {"n": np.full(len(b), len(b))}, "n long").collect()
    assert len(met) == 1500 and max(r.n for r in met) <= 256


def test_band_pairs_meet_by_cells_of_all_parameters(spark):
    rows = [(i, 0.01 * i, float(i % 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = P.band_pairs(df, "k", ["a", "b"], [2.0, 1.0])
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] != q[0] and abs(p[1] - q[1]) <= 2.0 and abs(p[2] - q[2]) <= 1.0}
    assert {tuple(r) for r in got.collect()} == want
    assert "c_b" in got._jdf.queryExecution().toString()  # rows far apart in the second one don't meet
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # few scan tasks would make all pairs


def test_windows_of_nine_bilinear_fits_are_made_once(spark, monkeypatch):
    from driftloom.plans import queries_more, registry

    kept = []
    monkeypatch.setattr(queries_more.Written, "keep", lambda self, df, keep=queries_more.Written.keep: kept.append(df) or keep(self, df))
    assert len(registry.QUERIES["bilinear_errors"](spark, "/root/testdata/sf0.001").collect()) == 9 and len(kept) == 1


def test_close_episodes_meet_without_their_pairs_laid_out(spark, monkeypatch):
    from driftloom.operators import matching as X

    rng = np.random.default_rng(5)
    x, a, b = np.round(rng.normal(size=(40, 6)), 1), np.round(rng.uniform(0, 6, 40), 1), rng.integers(0, 3, 40).astype(float)
    states = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(40) for t in range(6)], "ep long, t long, x double")
    eps = spark.createDataFrame([(i, 6, float(a[i]), float(b[i])) for i in range(40)], "ep long, n_steps long, a double, b double")
    close = lambda i, j: abs(a[i] - a[j]) <= 1.0 and abs(b[i] - b[j]) <= 1.0
    monkeypatch.setattr(X, "BAND_ROWS", 3)
    monkeypatch.setattr(X, "CANDIDATES", 16)
    curve = X.forward_divergence(states, eps, "x", ["a", "b"], [1.0, 1.0], 1, 4)
    logs = {s: [np.log(abs(x[i, s + 1] - x[j, s + 1])) for i in range(40) for j in range(i) if close(i, j) and x[i, s + 1] != x[j, s + 1]] for s in range(4)}
    got = {r.s: (r.mean_log, r.n) for r in curve.collect()}
    assert all(got[s][1] == len(logs[s]) and abs(got[s][0] - np.mean(logs[s])) < 1e-9 for s in range(4))
    near = X.matched_neighbours(states, eps, ["x"], ["a", "b"], [1.0, 1.0], 1, 1, 2)
    usable, want = [(i, t) for i in range(40) for t in range(1, 4)], {}
    for i, t in usable:
        found = [(round((x[i, t] - x[j, u]) ** 2, 12), j, u) for j, u in usable if i != j and close(i, j) and abs(t - u) <= 1]
        if found:
            want[i, t] = min(found)
    assert {(r.ep, r.t): (round(r.d2, 12), r.match, r.match_t) for r in near.collect()} == want
    for df in (curve, near):
        assert "FlatMapCoGroupsInPandas" in df._jdf.queryExecution().toString()


def test_neighbours_of_short_windows_are_searched_in_cells(spark, monkeypatch):
    from driftloom.operators import matching as X
    from driftloom.operators import sequences as Q

    rng = np.random.default_rng(6)
    x, y = rng.exponential(size=(150, 3)), rng.exponential(size=(400, 3))
    y[350:] = y[0]  # equal ones
    table = lambda v, name: spark.createDataFrame([(f"{name}{i}", [float(c) for c in r]) for i, r in enumerate(v)], "key string, w array<double>")
    monkeypatch.setattr(X, "CAP", 128)  # 400 rows are more than one cell's
    monkeypatch.setattr(X, "SAMPLE", 10_000)
    d = np.sort(np.sqrt(np.square(x[:, None] - y[None]).sum(2)), axis=1)[:, :5]
    got = {r.key: r for r in X.nearest_in_cells(table(x, "x"), table(y, "y"), "w", "key", 5).collect()}
    assert len(got) == 150 and all(np.allclose((got[f"x{i}"].score, got[f"x{i}"].kth, got[f"x{i}"].nearest), (r.mean(), r[4], r[0]), atol=1e-12) for i, r in enumerate(d))
    monkeypatch.setattr(Q, "knn_all", None)  # all rows would meet all
    assert Q.Neighbours(table(y, "y"), 5).table(table(x, "x")).count() == 150


@pytest.mark.parametrize("size", [7, 2000])
def test_replicates_of_both_kinds_share_one_pass(spark, monkeypatch, size):
    from driftloom.operators import resampling as U

    rng = np.random.default_rng(7)
    x, y, u = rng.normal(size=(50, 3)), (np.arange(50) % 3 == 0).astype(int), rng.integers(0, 2, (50, 4))
    t, kernel = rng.integers(0, 2, (50, 3)), P.Kernel("rbf", gamma=0.3)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), u[i].tolist(), t[i].tolist()) for i in range(50)], "k long, v array<double>, __y int, u array<tinyint>, t array<tinyint>")
    monkeypatch.setattr(P.meet, "__defaults__", (size,))
    monkeypatch.setattr(P, "TILE", 4)
    g = kernel(x, x)
    np.fill_diagonal(g, 0)
    permuted, drawn = U.kernel_sums(rows, "v", "k", kernel)
    for found, ones, zeros in ((permuted, u, 1 - u), (drawn, t * y[:, None], t * (1 - y)[:, None])):
        want = [[(a * (g @ b)).sum(0) for a, b in ((ones, ones), (zeros, zeros), (ones, zeros))]]
        assert np.allclose(found[["s11", "s00", "s10"]].to_numpy().T, want[0], rtol=1e-12)
    met = []
    monkeypatch.setattr(U, "meet", lambda *a, **kw: met.append(1) or P.meet(*a, **kw))
    assert U.mmd_interval(points(spark, x, y=y.tolist()), "v", "k", F.col("y") == 1, kernel, 20).first()["z_low"] is not None and len(met) == 1


def test_absolute_distances_of_odd_rows():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(60, 5))
    a[3], b[7] = -1e12, 1e12  # only their own pairs are rounded to it
    for x, y in ((a, b), (a[:, :1], b[:, :1]), (a + 1e6, b + 1e6), (a[:0], b), (a, b[:0])):
        want = np.abs(x[:, None] - y[None]).sum(2)
        got = P.absolute_distances(x, y)
        assert got.shape == want.shape and np.allclose(got, want, rtol=1e-12, atol=1e-12)
    a[0, 1], b[1, 2] = np.inf, -np.inf
    assert (P.absolute_distances(a, b) == np.abs(a[:, None] - b[None]).sum(2)).all()


def test_absolute_distances_pass_twice_over_a_coordinate(monkeypatch):
    a, b = np.random.default_rng(9).normal(size=(2, 20, 6))
    monkeypatch.setattr(np, "subtract", None)  # three passes of old: difference, absolute value, sum
    assert np.allclose(P.absolute_distances(a, b), np.abs(a[:, None] - b[None]).sum(2))
