"""Queries: volumes, proposals, smoothed moments, fixed-centre scores, residual features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import episodes as E
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import reduction as R
from ..operators import resampling as U
from ..operators import volume as V
from ..operators import windows as W
from ..scratch import Written
from .base import EVENTS, LINES, VECTORS, event_episodes, event_states, line_states, query, rounded, table, vectors
from .queries_kernels import FIT_ROWS, SQ


def _disc(level: float):
    """Whether the first two coordinates lie in a disc whose size comes from the vectors."""
    return lambda x: (x * x).sum(1) / level


def _plane(spark, d):
    """(points of the first two coordinates, at most a fit set; their mean squared length over all rows)."""
    v = vectors(spark, d)
    _, x = P.reference(v, "v", "vec_id", FIT_ROWS)
    level = v.agg(F.avg(F.col("v")[0] * F.col("v")[0] + F.col("v")[1] * F.col("v")[1])).first()[0]
    return x[:, :2], float(level)


@query()
def importance_volume(spark, d):
    centres, level = _plane(spark, d)
    reach = 2 * float(np.sqrt(level))
    return V.importance_volume(spark, _disc(level), 1.0, [-reach, -reach], [reach, reach], centres, V.proposal_width(centres), 100_000)


@query()
def proposals_in_set(spark, d):
    base, level = _plane(spark, d)
    return V.proposals(spark, _disc(level), 1.0, 2000, base=base, spread=0.1 * float(np.sqrt(level))).select("draw", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@query(f"""WITH {VECTORS}, x AS (SELECT v[1] AS x FROM vectors), e AS (SELECT [1, avg(x), avg(x * x + 0.25), avg(x * x * x + 0.75 * x), avg(power(x, 4) + 1.5 * x * x + 0.1875)] AS e FROM x)
SELECT i, j, round(e[i + j + 1], 6) AS m FROM e, generate_series(0, 2) a(i), generate_series(0, 2) b(j)""")
def smoothed_moment_matrix(spark, d):
    m = V.smoothed_moments_all(vectors(spark, d).select(F.col("v")[0].alias("x")), ["x"], 2, 0.5)
    return spark.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(3) for j in range(3)], "i long, j long, m double")


@query("""WITH g AS (SELECT l_returnflag || l_linestatus AS flag, avg(l_quantity) / 10 AS m, var_pop(l_quantity) / 100 AS v FROM lineitem GROUP BY 1)
SELECT a.flag AS a, b.flag AS b, round(exp(-0.5 * power(a.m - b.m, 2) / (1 + (a.v + b.v))) / sqrt(1 + (a.v + b.v)), 6) AS value FROM g a, g b""")
def exact_mean_embedding(spark, d):
    """Products of the embeddings of the normal variables that have each group's mean and variance."""
    rows = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("flag")).agg((F.avg("l_quantity") / 10).alias("m"), (F.var_pop("l_quantity") / 100).alias("v")).collect()  # a row a flag
    pairs = [(a["flag"], b["flag"], round(V.gaussian_embedding_product(a["m"], b["m"], a["v"], b["v"], 0.5), 6)) for a in rows for b in rows]
    return spark.createDataFrame(pairs, "a string, b string, value double")


@query(f"WITH {EVENTS} SELECT n::BIGINT AS n, round(avg(exp(-0.0001 * power(a.x - b.x, 2))), 6) AS value FROM (SELECT unnest([5, 10, 20]) AS n), states a, states b WHERE a.ep = 1 AND b.ep = 2 AND a.t < n AND b.t < n GROUP BY n")
def prefix_mean_embedding(spark, d):
    return rounded(V.prefix_embedding(event_states(spark, d), 1, 2, 0.0001, [5, 10, 20]))


@query(f"WITH {LINES}, u AS (SELECT ep, t, quantity, lead(quantity) OVER (PARTITION BY ep ORDER BY t) AS nxt FROM states), f AS (SELECT ep, t, nxt, quantity, regr_slope(nxt, quantity) FILTER (ep % 2 = 0) OVER () AS b, regr_intercept(nxt, quantity) FILTER (ep % 2 = 0) OVER () AS a FROM u) SELECT ep, t, round(nxt - a - b * quantity, 5) AS residual FROM f WHERE nxt IS NOT NULL")
def next_state_residuals(spark, d):
    s = line_states(spark, d).select("ep", "t", "quantity", F.lead("quantity").over(W.steps()).alias("nxt"))
    return rounded(V.linear_residuals(s, ["quantity"], "nxt", F.col("ep") % 2 == 0).select("ep", "t", "residual"), 5)


@query()
def residual_polynomial_score(spark, d):
    s = line_states(spark, d).select("ep", "t", "quantity", F.lead("quantity").over(W.steps()).alias("nxt"))
    r = E.normalize_channels(V.linear_residuals(s, ["quantity"], "nxt", F.col("ep") % 2 == 0).select("ep", "t", "residual"), ["residual"])
    return D.CDPolynomial.fit(r.filter("ep % 2 = 0"), ["residual"], 3, "hermite", 1e-9).score(r).select("ep", "t", F.log("score").alias("log_cd"))


@query()
def phase_plane_alarm(spark, d):
    s = event_states(spark, d).select("ep", "t", ((F.col("x") - 50) / 50).alias("a"), (W.difference("x") / 50).alias("b")).filter("b is not null")
    good = s.join(E.survived(event_episodes(event_states(spark, d))).select("ep"), "ep", "left_semi")
    top = D.CDPolynomial.fit(good.filter("ep % 5 <> 0"), ["a", "b"], 2, "chebyshev", 1e-9).score(good.filter("ep % 5 = 0")).groupBy("ep").agg(F.max("score").alias("m"))
    return top.agg(F.percentile("m", F.lit(0.9)).alias("q90"), F.count("*").alias("n"))


@query()
def fixed_centre_scores(spark, d):
    v = vectors(spark, d)
    _, x = P.reference(v.filter("label < 5"), "v", "vec_id", FIT_ROWS)
    kernel = P.Kernel("rbf", gamma=0.5)
    f = R.nystrom(x[R.farthest_points(x, 40)[0]], kernel, 1e-10)
    phi = f(x)
    inner = 1e-2 * np.linalg.inv(phi.T @ phi / len(x) + 1e-2 * np.eye(phi.shape[1]))
    score = lambda y: (p := f(y), np.maximum(kernel.diag(y) - (p * p).sum(1), 0) + np.einsum("ij,jk,ik->i", p, inner, p))[1]
    return D._score_blocks(v, "v", score).select("vec_id", "score")


@query()
def landmark_kernel_scores(spark, d):
    v = vectors(spark, d)
    f = R.nystrom(R.kmeans_landmarks(v.filter("label < 5"), "v", 32), P.Kernel("rbf", gamma=0.5))
    phi = R.map_vectors(v, "v", f, "phi")
    n, _, g = R.second_moment(phi.filter("label < 5"), "phi")
    inner = np.linalg.inv(g + 1e-3 * n * np.eye(len(g)))
    return D._score_blocks(phi, "phi", lambda p: 1 - (p * p).sum(1) + 1e-3 * n * np.einsum("ij,jk,ik->i", p, inner, p)).select("vec_id", "score")


@query(f"""WITH {VECTORS}, g AS (SELECT unnest(['(0, 1, 2)', '(3, 4, 5, 6)']) AS fitted_on), s AS (SELECT fitted_on, a.vec_id, a.label >= 7 AS y, round(list_avg(min(sqrt({SQ}), 5)), 9) AS score FROM g, vectors a, vectors b
WHERE (b.label BETWEEN 0 AND 2) = (fitted_on = '(0, 1, 2)') AND b.label BETWEEN 0 AND 6 GROUP BY 1, 2, 3), r AS (SELECT *, rank() OVER (PARTITION BY fitted_on ORDER BY score) + (count(*) OVER (PARTITION BY fitted_on, score) - 1) / 2.0 AS rk FROM s)
SELECT fitted_on, round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) AS auroc FROM r GROUP BY fitted_on""")
def cross_group_evaluation(spark, d):
    v = vectors(spark, d).withColumn("y", (F.col("label") >= 7).cast("int"))
    out = None
    for group in ((0, 1, 2), (3, 4, 5, 6)):
        s = D.KNN.fit(v.filter(F.col("label").isin(*group)), "v", "vec_id", 5).score(v, ["label", "y"]).withColumn("score", F.round("score", 9))
        s = Written(spark, "cross-group").keep(s)
        row = M.auroc(s, "y").select(F.lit(str(group)).alias("fitted_on"), "auroc")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query()
def mmd_with_interval(spark, d):
    return U.mmd_interval(vectors(spark, d), "v", "vec_id", F.col("label") < 3, P.Kernel("rbf", gamma=0.5), 100)
