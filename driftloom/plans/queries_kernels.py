"""Queries: kernels, neighbours, bases, detectors, signals, reductions, sources, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import bases as B
from ..operators import detectors as D
from ..operators import factorizations as FA
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import reduction as R
from ..operators import resampling as U
from ..operators import signals as S
from ..operators import windows as W
from ..scratch import Written
from ..sources import tables as T
from .base import EVENTS, LINES, VECTORS, event_states, line_states, query, rank_sql, rounded, table, vectors

REF = f"{VECTORS}, ref AS (SELECT * FROM vectors)"
#: Rows that kernel methods are fitted on, at most.
FIT_ROWS = 1000
#: Dot product and distances of two list columns.
DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"
SQ = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
L1 = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))"


def _ref(spark, d, n=FIT_ROWS):
    return P.reference(vectors(spark, d), "v", "vec_id", n)


def _cuts(spark, d, n=32):
    """Every run of ``n`` steps of an episode as one of its own; the last may be shorter."""
    return S.windows(line_states(spark, d), n)


def _gram(kernel):
    def run(spark, d):
        v = vectors(spark, d)
        g = P.gram_all(v, v, "v", "vec_id", kernel)
        return rounded(g.select("vec_id", "k_mean"))

    return run


for _name, _kernel, _sql in (
    ("kernel_rbf", P.Kernel("rbf", gamma=0.5), f"exp(-0.5 * {SQ})"),
    ("kernel_abel", P.Kernel("abel", gamma=0.5), f"exp(-0.5 * sqrt({SQ}))"),
    ("kernel_laplace", P.Kernel("laplace", gamma=0.2), f"exp(-0.2 * {L1})"),
    ("kernel_linear", P.Kernel("linear", c=1.0), f"({DOT} + 1.0)"),
    ("kernel_polynomial", P.Kernel("poly", gamma=0.5, c=1.0, degree=3), f"power(0.5 * {DOT} + 1.0, 3)"),
):
    query(f"WITH {REF} SELECT a.vec_id, round(avg({_sql}), 6) AS k_mean FROM vectors a, ref b GROUP BY a.vec_id", _name)(_gram(_kernel))

#: Magnitudes of the vectors' Fourier transforms, by the length.
MAGNITUDES = f"""{VECTORS}, x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j, len(v) AS n FROM vectors),
mag AS (SELECT vec_id, k, sqrt(power(sum(x * cos(2 * pi() / n * (k * j % n))), 2) + power(sum(x * sin(2 * pi() / n * (k * j % n))), 2)) / any_value(n) AS mag FROM x, (SELECT unnest(range(max(n))) AS k FROM x) WHERE k < n GROUP BY vec_id, k),
fv AS (SELECT vec_id, list(mag ORDER BY k) AS v FROM mag GROUP BY vec_id)"""
for _name, _kernel, _sql in (
    ("kernel_polyfft", P.Kernel("polyfft", degree=2), f"power(1 + {DOT}, 2)"),
    ("kernel_gaussfft", P.Kernel("gaussfft", gamma=1.0), f"exp(-{SQ})"),
):
    query(f"WITH {MAGNITUDES} SELECT a.vec_id, round(avg({_sql}), 6) AS k_mean FROM fv a, fv b GROUP BY a.vec_id", _name)(_gram(_kernel))


@query(f"WITH {REF}, s AS (SELECT a.vec_id, avg(exp(-0.5 * {SQ})) AS k FROM vectors a, ref b GROUP BY a.vec_id), m AS (SELECT avg(exp(-0.5 * {SQ})) AS kk FROM ref a, ref b) SELECT vec_id, round(1 - 2 * k + kk, 6) AS score FROM s, m")
def mean_map_distance(spark, d):
    v = vectors(spark, d)
    g = Written(spark, "mean-map").keep(P.gram_all(v, v, "v", "vec_id", P.Kernel("rbf", gamma=0.5)))
    level = g.agg(F.avg("k_mean")).first()[0]
    return rounded(g.select("vec_id", (F.col("k_self") - 2 * F.col("k_mean") + level).alias("score")))


@query(f"WITH {REF}, p AS (SELECT a.label < 3 AS ya, b.label < 3 AS yb, exp(-0.5 * {SQ}) AS k FROM ref a, ref b WHERE a.vec_id <> b.vec_id), n AS (SELECT count(*) FILTER (label < 3) AS n1, count(*) FILTER (label >= 3) AS n0 FROM ref) "
       "SELECT round(sum(k) FILTER (ya AND yb) / max(n1 * (n1 - 1)) + sum(k) FILTER (NOT ya AND NOT yb) / max(n0 * (n0 - 1)) - 2 * sum(k) FILTER (ya AND NOT yb) / max(n1 * n0), 6) AS mmd2 FROM p, n")
def mmd2_unbiased(spark, d):
    return rounded(P.mmd2(vectors(spark, d), "v", "vec_id", F.col("label") < 3, P.Kernel("rbf", gamma=0.5)))


@query()
def mmd_permutation_test(spark, d):
    return U.mmd_permutation(vectors(spark, d), "v", "vec_id", F.col("label") < 3, P.Kernel("rbf", gamma=0.5), 100)


@query(f"WITH {REF} SELECT round(median(dist), 6) AS med FROM (SELECT sqrt({SQ}) AS dist FROM ref a, ref b WHERE a.vec_id < b.vec_id) WHERE dist > 0")
def median_bandwidth(spark, d):
    return spark.range(1).select(F.round(F.lit(P.median_of_pairs(vectors(spark, d), "v", "vec_id")), 6).alias("med"))


@query(f"WITH {REF} SELECT round(median(dist), 6) AS med FROM (SELECT min(sqrt({SQ})) AS dist FROM ref a, ref b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id) WHERE dist > 0")
def median_neighbour_distance(spark, d):
    v = vectors(spark, d)
    near = Written(spark, "neighbours").keep(P.knn_all(v, v, "v", "vec_id", 1, skip_self=True).filter("nearest > 0"))
    return spark.range(1).select(F.round(F.lit(M.quantiles(near, "nearest", [0.5])[0]), 6).alias("med"))


KNN = f"{REF}, nn AS (SELECT a.vec_id, sqrt({SQ}) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQ}, b.vec_id) AS r FROM vectors a, ref b)"


@query(f"WITH {KNN} SELECT vec_id, round(avg(dist), 6) AS score, round(max(dist), 6) AS kth FROM nn WHERE r <= 5 GROUP BY vec_id")
def knn_scores(spark, d):
    v = vectors(spark, d)
    return rounded(P.knn_all(v, v, "v", "vec_id", 5).select("vec_id", "score", "kth"))


@query(f"WITH {KNN}, s AS (SELECT a.vec_id, avg(dist) AS score, any_value(label < 2) AS y FROM nn a JOIN vectors USING (vec_id) WHERE r <= 5 GROUP BY a.vec_id), r AS (SELECT y, rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0 AS rk FROM s) "
       "SELECT round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) AS auroc FROM r")
def auroc_of_knn(spark, d):
    from ..operators.metrics import auroc

    v = vectors(spark, d)
    s = P.knn_all(v, v, "v", "vec_id", 5).join(v.select("vec_id", "label"), "vec_id").select((F.col("label") < 2).cast("int").alias("label"), F.round("score", 9).alias("score"))
    return rounded(auroc(Written(spark, "auroc").keep(s)).select("auroc"))


@query(f"WITH {REF}, nn AS (SELECT a.vec_id, sqrt({SQ}) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQ}) AS r FROM ref a, ref b WHERE a.vec_id <> b.vec_id), "
       "mu AS (SELECT vec_id, max(dist) FILTER (r = 2) / max(dist) FILTER (r = 1) AS mu FROM nn WHERE r <= 2 GROUP BY vec_id HAVING max(dist) FILTER (r = 1) > 1e-6), k AS (SELECT floor(count(*) * 0.9) AS keep FROM mu), "
       "rk AS (SELECT ln(mu) AS x, row_number() OVER (ORDER BY mu) AS i, keep FROM mu, k), xy AS (SELECT x, -ln(1 - i / (keep + 1)) AS y FROM rk WHERE i <= keep) SELECT round(sum(x * y) / sum(x * x), 4) AS dimension FROM xy")
def two_nn_dimension(spark, d):
    return rounded(P.two_nn_dimension(vectors(spark, d), "v", "vec_id"), 4)


@query("SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 2.0 AND abs(a.c_nationkey - b.c_nationkey) <= 1")
def parameter_band_pairs(spark, d):
    return P.band_pairs(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], [2.0, 1.0])


@query(f"WITH {LINES} SELECT ep, t, round(quantity * quantity - 2 * quantity * tax + tax * tax, 6) AS quad FROM states")
def quadratic_features(spark, d):
    f = B.features(["quantity", "tax"], 2)
    return rounded(line_states(spark, d).select("ep", "t", (f["phi_2_0"] - 2 * f["phi_1_1"] + f["phi_0_2"]).alias("quad")))


@query(f"WITH {LINES}, u AS (SELECT ep, t, (2 * quantity - 51) / 49.0 AS x FROM states) SELECT ep, t, round(4 * x * x * x - 3 * x, 6) AS t3, round(x * x * x - 3 * x, 6) AS h3, round((5 * x * x * x - 3 * x) / 2, 6) AS p3 FROM u")
def orthogonal_polynomials(spark, d):
    s = line_states(spark, d).select("ep", "t", ((2 * F.col("quantity") - 51) / 49.0).alias("x"))
    return rounded(s.select("ep", "t", B.ladder(F.col("x"), 3, "chebyshev")[3].alias("t3"), B.ladder(F.col("x"), 3, "hermite")[3].alias("h3"), B.ladder(F.col("x"), 3, "legendre")[3].alias("p3")))


@query(f"WITH {LINES}, u AS (SELECT ep, t, (2 * quantity - 51) / 49.0 AS x FROM states) SELECT ep, t, round(1 + 3 * x * x + 5 * power((3 * x * x - 1) / 2, 2), 6) AS uniform, round(1 + 2 * x * x + 2 * power(2 * x * x - 1, 2), 6) AS arcsine FROM u")
def exact_christoffel(spark, d):
    s = line_states(spark, d).select("ep", "t", ((2 * F.col("quantity") - 51) / 49.0).alias("x"))
    return rounded(s.select("ep", "t", B.cd_uniform(F.col("x"), 2).alias("uniform"), B.cd_arcsine(F.col("x"), 2).alias("arcsine")))


@query(f"WITH {LINES} SELECT round(avg(quantity), 6) AS m01, round(avg(discount), 8) AS m02, round(avg(quantity * quantity), 6) AS m11, round(avg(quantity * discount), 6) AS m12, round(avg(discount * discount), 8) AS m22 FROM states")
def moment_matrix(spark, d):
    m = D.CDPolynomial.moments(line_states(spark, d), ["quantity", "discount"], 1)
    row = [round(float(m[0, 1]), 6), round(float(m[0, 2]), 8), round(float(m[1, 1]), 6), round(float(m[1, 2]), 6), round(float(m[2, 2]), 8)]
    return spark.range(1).select(*[F.lit(v).alias(n) for v, n in zip(row, ("m01", "m02", "m11", "m12", "m22"), strict=True)])


CD1 = f"""WITH {LINES}, m AS (SELECT *, avg(quantity) OVER () AS a, avg(discount) OVER () AS b, var_pop(quantity) OVER () AS v, var_pop(discount) OVER () AS w, covar_pop(quantity, discount) OVER () AS c FROM states)
SELECT ep, t, round(1 + (w * power(quantity - a, 2) - 2 * c * (quantity - a) * (discount - b) + v * power(discount - b, 2)) / (v * w - c * c), 5) AS score FROM m"""


@query(CD1)
def cd_score_degree1(spark, d):
    s = line_states(spark, d)
    return rounded(D.CDPolynomial.fit(s, ["quantity", "discount"], 1).score(s).select("ep", "t", "score"), 5)


@query(CD1)
def cd_score_qr(spark, d):
    s = line_states(spark, d).select("ep", "t", "quantity", "discount")
    return rounded(D.CDPolynomial.fit(s, ["quantity", "discount"], 1, method="qr").score(s).select("ep", "t", "score"), 5)


@query()
def cd_score_degree3(spark, d):
    s = line_states(spark, d).select("ep", "t", ((F.col("quantity") - 25.5) / 14.4).alias("q"), ((F.col("discount") - 0.05) / 0.0316).alias("s"))
    return D.CDPolynomial.fit(s, ["q", "s"], 3, "hermite", eps=1e-9).score(s).select("ep", "t", "score")


@query()
def kerncd_scores(spark, d):
    v = vectors(spark, d)
    return D.KernCD.fit(v.filter("label < 5"), "v", "vec_id", "rbf", lam=1e-3, n=FIT_ROWS).score(v, "v").select("vec_id", "label", "score")


@query()
def kerncd_low_rank(spark, d):
    v = vectors(spark, d)
    return D.KernCD.fit(v.filter("label < 5"), "v", "vec_id", "rbf", lam=1e-3, n=FIT_ROWS, rank=60, pivot="greedy").score(v, "v").select("vec_id", "label", "score")


@query()
def kerncd_low_rank_all(spark, d):
    """Every row of the fitted labels is a candidate for a pivot and a fit row."""
    v = vectors(spark, d)
    model = D.KernCD.fit_all(v.filter("label < 5"), "v", "vec_id", P.Kernel("rbf", gamma=0.5), 60, 1e-3)
    return model.score(v, "v").select("vec_id", "label", "score")


#: Pivots by greatest residual over all vectors: three columns of the factor by hand, in SQL.
PIVOTS = f"""WITH {VECTORS}, one AS (SELECT vec_id, v FROM vectors ORDER BY vec_id LIMIT 1),
c1 AS (SELECT a.vec_id, a.v, exp(-0.5 * {SQ}) AS f1 FROM vectors a, one b), d1 AS (SELECT *, 1 - f1 * f1 AS d FROM c1), two AS (SELECT * FROM d1 ORDER BY round(d, 12) DESC, vec_id LIMIT 1),
c2 AS (SELECT a.*, (exp(-0.5 * {SQ}) - a.f1 * b.f1) / sqrt(b.d) AS f2 FROM d1 a, two b), d2 AS (SELECT vec_id, v, f1, f2, greatest(d - f2 * f2, 0) AS d FROM c2), three AS (SELECT * FROM d2 ORDER BY round(d, 12) DESC, vec_id LIMIT 1)
SELECT 0 AS step, vec_id, 1.0::DOUBLE AS residual FROM one UNION ALL SELECT 1, vec_id, round(d, 6) FROM two UNION ALL SELECT 2, vec_id, round(d, 6) FROM three"""


@query(PIVOTS)
def greedy_pivots(spark, d):
    got = FA.pivoted_cholesky_all(vectors(spark, d), "v", "vec_id", P.Kernel("rbf", gamma=0.5), 3)
    rows = [(i, int(k), round(float(got.triangle[i, i] ** 2), 6)) for i, k in enumerate(got.keys)]
    return spark.createDataFrame(rows, "step int, vec_id long, residual double")


@query()
def kerncd_online(spark, d):
    v = vectors(spark, d)
    m = D.KernCD.fit(v.filter("label < 5"), "v", "vec_id", "rbf", lam=1e-3, n=FIT_ROWS)
    _, extra = P.reference(v.filter("label = 5"), "v", "vec_id", 20)
    return m.batch_update(extra).score(v, "v").select("vec_id", "score")


@query()
def reconstruction_error(spark, d):
    v = vectors(spark, d)
    return D.LinearReconstruction.fit(v.filter("label < 5"), "v", 16).score(v, "v").select("vec_id", "score")


@query()
def rudi_support(spark, d):
    v = vectors(spark, d)
    _, x = P.reference(v.filter("label < 5"), "v", "vec_id", FIT_ROWS)
    m = D.RudiSupport.fit_points(x, P.Kernel("rbf", gamma=0.5), 40)
    return D._score_blocks(v, "v", m.score_points).select("vec_id", "score")


FOURIER = f"""{LINES}, cuts AS (SELECT ep * 100000 + t // 64 AS ep, t % 64 AS t, quantity AS x FROM states), sig AS (SELECT * FROM cuts WHERE ep IN (SELECT ep FROM cuts GROUP BY ep HAVING count(*) = 64)),
dft AS (SELECT ep, k, sum(x * cos(2 * pi() / 64 * (k * t % 64))) AS re, -sum(x * sin(2 * pi() / 64 * (k * t % 64))) AS im FROM sig, generate_series(0, 32) g(k) GROUP BY ep, k),
p AS (SELECT ep, k, re, im, re * re + im * im AS p FROM dft)"""


@query(f"WITH {FOURIER} SELECT ep, k, round(sqrt(p), 5) AS mag FROM p")
def fourier_magnitudes(spark, d):
    return rounded(S.spectrum(_cuts(spark, d, 64), "quantity", 64).select("ep", "k", "mag"), 5)


@query(f"WITH {FOURIER} SELECT ep, round(arg_max(k, round(sqrt(p), 9) - k * 1e-13) / 64.0, 6) AS freq FROM p WHERE k > 0 GROUP BY ep")
def dominant_frequency(spark, d):
    return rounded(S.dominant_frequency(_cuts(spark, d, 64), "quantity", 64))


@query(f"WITH {FOURIER}, q AS (SELECT ep, p / (sum(p) OVER (PARTITION BY ep) + 1e-12) AS q FROM p) SELECT ep, round(-sum(q * ln(q + 1e-12)) / ln(33), 6) AS entropy FROM q GROUP BY ep")
def spectral_entropy(spark, d):
    return rounded(S.spectral_entropy(_cuts(spark, d, 64), "quantity", 64))


@query(f"WITH {FOURIER} SELECT ep, t::BIGINT AS t, round(sum(CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END * (re * cos(2 * pi() / 64 * (k * t % 64)) - im * sin(2 * pi() / 64 * (k * t % 64)))) / 64, 5) AS y FROM p, generate_series(0, 63) s(t) WHERE k <= 5 GROUP BY ep, t")
def harmonic_reconstruction(spark, d):
    return rounded(S.reconstruction(_cuts(spark, d, 64), "quantity", 64, 5), 5)


ACF = f"""{LINES}, cuts AS (SELECT ep * 100000 + t // 64 AS ep, t % 64 AS t, quantity FROM states), c AS (SELECT ep, t, quantity - avg(quantity) OVER (PARTITION BY ep) AS v FROM cuts),
a AS (SELECT x.ep, y.t - x.t AS lag, sum(x.v * y.v) AS s FROM c x JOIN c y ON x.ep = y.ep AND y.t - x.t BETWEEN 0 AND 20 GROUP BY 1, 2),
z AS (SELECT *, first_value(s) OVER (PARTITION BY ep ORDER BY lag) AS s0 FROM a), f AS (SELECT ep, lag, CASE WHEN s0 > 1e-12 THEN s / s0 END AS acf FROM z)"""


@query(f"WITH {ACF} SELECT ep, lag, round(acf, 6) AS acf FROM f")
def autocorrelation(spark, d):
    return rounded(S.autocorrelation(_cuts(spark, d, 64), "quantity", 64, 20))


@query(f"WITH {ACF}, p AS (SELECT ep, lag, round(acf, 9) > lag(round(acf, 9)) OVER w AND round(acf, 9) >= lead(round(acf, 9)) OVER w AS peak FROM f WINDOW w AS (PARTITION BY ep ORDER BY lag)) SELECT ep, coalesce(min(CASE WHEN peak AND lag >= 2 THEN lag END), 64) AS period FROM p GROUP BY ep")
def acf_period(spark, d):
    return S.acf_period(_cuts(spark, d, 64), "quantity", 64, 20)


@query(f"WITH {ACF} SELECT ep, greatest(coalesce(min(CASE WHEN round(acf, 9) <= 0 THEN lag END), 64), 2) AS width FROM f GROUP BY ep")
def acf_zero_window(spark, d):
    return S.acf_window(_cuts(spark, d, 64), "quantity", 64, 20)


@query(f"WITH {FOURIER}, f AS (SELECT ep, arg_max(k, round(sqrt(p), 9) - k * 1e-13) / 64.0 AS freq FROM p WHERE k > 0 GROUP BY ep) SELECT least(64, greatest(1, round_even(1 / median(freq), 0)))::BIGINT AS width FROM f")
def window_from_spectrum(spark, d):
    return S.window_from_peak(_cuts(spark, d, 64), "quantity", 64)


@query(f"WITH {LINES}, b AS (SELECT ep * 100000 + t // 32 AS ep, k, sum(quantity * sin(pi() * (t % 32) / 31.0 * k)) AS s FROM states, generate_series(1, 3) g(k) GROUP BY 1, k) SELECT ep, k - 1 AS k, round(s, 6) AS proj FROM b")
def sine_projection(spark, d):
    b = B.temporal_matrix("sine", 32, 3)
    return rounded(B.coefficients(_cuts(spark, d), "quantity", b.T).withColumnRenamed("coef", "proj"))


@query()
def bspline_coefficients(spark, d):
    return B.coefficients(_cuts(spark, d), "price", B.encoder(B.temporal_matrix("bspline", 32, 6)))


@query(f"WITH {LINES}, s AS (SELECT quantity - lag(quantity) OVER w AS a, tax - lag(tax) OVER w AS b FROM states WINDOW w AS (PARTITION BY ep ORDER BY t)) SELECT round(avg(a * a), 5) AS qq, round(avg(a * b), 7) AS qt, round(avg(b * b), 9) AS tt FROM s WHERE a IS NOT NULL")
def step_covariance(spark, d):
    c, _ = R.whitener(line_states(spark, d), ["quantity", "tax"])
    return spark.range(1).select(F.lit(round(float(c[0, 0]), 5)).alias("qq"), F.lit(round(float(c[0, 1]), 7)).alias("qt"), F.lit(round(float(c[1, 1]), 9)).alias("tt"))


@query(f"WITH {LINES} SELECT min(quantity) - 0.1 * (max(quantity) - min(quantity)) AS low_quantity, round(max(quantity) + 0.1 * (max(quantity) - min(quantity)), 6) AS high_quantity FROM states")
def bounding_box(spark, d):
    return rounded(R.bounding_box(line_states(spark, d), ["quantity"], 0.1))


@query()
def principal_scores(spark, d):
    v = vectors(spark, d)
    z = R.PCA.fit(v, "v", 3).transform(v, "v")
    return z.select("vec_id", *[F.round(F.abs(F.col("z")[i]), 6).alias(f"z{i}") for i in range(3)])


@query()
def nystrom_features(spark, d):
    v = vectors(spark, d)
    _, x = _ref(spark, d, FIT_ROWS)
    f = R.nystrom(x, P.Kernel("rbf", gamma=0.5))
    return R.map_vectors(v, "v", f, "phi").select("vec_id", F.size("phi").cast("long").alias("rank"), F.aggregate("phi", F.lit(0.0), lambda a, p: a + p * p).alias("norm2"))


@query()
def kmeans_landmarks(spark, d):
    c = R.kmeans_landmarks(vectors(spark, d), "v", 8)
    return spark.createDataFrame([(i, float(np.linalg.norm(r))) for i, r in enumerate(c)], "centre long, norm double")


@query(f"""WITH RECURSIVE {REF}, far AS (SELECT 0 AS r, a.vec_id, a.v, b.vec_id AS picked, sqrt({SQ}) AS d FROM ref a, (SELECT * FROM ref ORDER BY vec_id LIMIT 1) b
UNION ALL SELECT r + 1, a.vec_id, a.v, b.vec_id, least(a.d, sqrt({SQ})) FROM far a, (SELECT vec_id, v FROM far ORDER BY d DESC, vec_id LIMIT 1) b WHERE r < 9)
SELECT r::BIGINT AS r, any_value(picked) AS vec_id, round((SELECT max(d) FROM far WHERE r = 9), 6) AS fill FROM far GROUP BY r""")
def farthest_point_centres(spark, d):
    keys, _, fill = R.farthest_points_all(vectors(spark, d), "v", "vec_id", 10)
    return spark.createDataFrame([(r, int(key), round(fill, 6)) for r, key in enumerate(keys)], "r long, vec_id long, fill double")


@query()
def tucker_error(spark, d):
    w = W.sliding(line_states(spark, d), ["quantity", "price", "discount", "tax"], 20, 20)
    n, s, g = R.second_moment(w.select(F.flatten("w").alias("w")), "w")
    scale = np.tile(np.sqrt(np.maximum((np.diag(g) / n - (s / n) ** 2).reshape(20, 4).mean(0), 1e-300)), 20)
    fits = [(k, R.Tucker13.from_moments(n, s / scale, g / np.outer(scale, scale), 4, 5 * k, k)) for k in (1, 2, 3, 4)]
    return spark.createDataFrame([(k, f.error) for k, f in fits], "rank long, error double")


@query()
def acceptance_volume(spark, d):
    """Volume, in the box of the states, of what a polynomial score fitted on them accepts at its mean."""
    s = line_states(spark, d).select(((F.col("quantity") - 25.5) / 14.4).alias("a"), ((F.col("discount") - 0.05) / 0.0316).alias("b"))
    model = D.CDPolynomial.fit(s, ["a", "b"], 2, "hermite", 1e-9)
    box = R.bounding_box(s, ["a", "b"], 0.1).first()
    low, high = ([box[f"{side}_{c}"] for c in "ab"] for side in ("low", "high"))

    def accepts(c):
        value = F.lit(0.0)
        for i, x in enumerate(basis := _named_features(c)):
            for j, y in enumerate(basis):
                value = value + float(model.inverse[i, j]) * x * y
        return value <= model.mean_score

    return R.acceptance_volume(spark, low, high, accepts, 100_000, 3)


def _named_features(c):
    """Hermite products up to degree 2 of two Columns, in the order of the basis."""
    one, (x, y) = F.lit(1.0), c
    return [one, x, y, x * x - 1, x * y, y * y - 1]


@query()
def random_fourier_embedding(spark, d):
    f = R.random_fourier(64, 0.5, 128)
    return R.map_vectors(vectors(spark, d), "v", f, "phi").groupBy("label").agg(F.avg(F.col("phi")[0]).alias("phi0"), F.count("*").alias("n"))


def _ou_fit(spark, d):
    """(episodes, theta, sigma) per step of the process that the events follow in units of their deviation."""
    s = event_states(spark, d)
    row = s.withColumn("nxt", F.lead("x").over(W.steps())).agg(F.countDistinct("ep"), F.regr_slope("nxt", "x"), F.stddev_pop("x")).first()
    slope = min(max(row[1] or 0.0, 0.0), 0.999)
    return row[0], 1 - slope, float(np.sqrt(max(1 - slope * slope, 1e-6)))


@query()
def ou_paths(spark, d):
    """A path for each episode of the events, by the step and noise that fit them."""
    n, theta, sigma = _ou_fit(spark, d)
    return T.simulate_ou(spark, n, 50, theta, sigma, 1.0)


@query()
def van_der_pol_paths(spark, d):
    """A noisy oscillator for each episode of the events, with their noise."""
    n, _, sigma = _ou_fit(spark, d)
    return T.simulate_van_der_pol(spark, n, 50, 1.0, 0.1 * sigma)


@query(f"WITH {EVENTS}, e AS (SELECT ep, t, (x > 200)::INT AS terminal FROM states) SELECT ep AS run, t AS pos, t - coalesce(lag(t) OVER (PARTITION BY ep ORDER BY t), -1) AS length FROM e WHERE terminal = 1")
def episode_lengths(spark, d):
    s = event_states(spark, d).select(F.col("ep").alias("run"), F.col("t").alias("pos"), (F.col("x") > 200).cast("int").alias("terminal"))
    return T.episode_lengths(s).select("run", "pos", "length")


@query("SELECT n_nationkey::BIGINT AS nation, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def broadcast_attributes(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy(F.col("n_nationkey").cast("long").alias("nation")).agg(F.count("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("balance"))
