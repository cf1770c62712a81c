"""Queries: matching, per-step statistics, trajectory kernels and the remaining evaluation pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bases as B
from ..operators import detectors as D
from ..operators import episodes as E
from ..operators import matching as X
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import reduction as R
from ..operators import signals as S
from ..operators import trajectory_kernels as K
from ..operators import windows as W
from ..scratch import Written
from ..sources import tables as T
from . import experiment
from .base import EVENTS, LINES, VECTORS, event_episodes, event_states, line_states, query, rank_sql, rounded, split_sql, table, vectors
from .queries_kernels import FIT_ROWS, SQ


@query("""WITH r AS (SELECT c_custkey AS k, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer WHERE c_custkey % 3 = 0), m AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb FROM r),
p AS (SELECT c.c_custkey, r.k, sqrt(power((c.c_acctbal - r.a) / sa, 2) + power((c.c_nationkey - r.b) / sb, 2)) AS d FROM customer c, r, m WHERE c.c_custkey % 3 = 1)
SELECT c_custkey, round(min(d), 6) AS distance FROM p GROUP BY c_custkey""")
def nearest_success_match(spark, d):
    c = table(spark, d, "customer").withColumn("b", F.col("c_nationkey").cast("double"))
    return rounded(X.nearest_match(c.filter("c_custkey % 3 = 1"), c.filter("c_custkey % 3 = 0"), "c_custkey", ["c_acctbal", "b"]).select("c_custkey", "distance"))


DIVERGE = f"""{EVENTS}, pr AS (SELECT ep, avg(x) AS m FROM states GROUP BY ep), ab AS (SELECT a.ep AS a, b.ep AS b FROM pr a JOIN pr b ON a.ep < b.ep AND abs(a.m - b.m) <= 1.0),
c AS (SELECT sa.t - 5 AS s, avg(ln(abs(sa.x - sb.x))) AS mean_log, count(*) AS n FROM ab JOIN states sa ON sa.ep = ab.a JOIN states sb ON sb.ep = ab.b AND sb.t = sa.t WHERE sa.t >= 5 AND sa.t < 25 AND sa.x <> sb.x GROUP BY 1)"""


@query(f"WITH {DIVERGE} SELECT s, round(mean_log, 6) AS mean_log, n FROM c")
def forward_divergence(spark, d):
    s = event_states(spark, d)
    params = s.groupBy("ep").agg(F.avg("x").alias("m"))
    return rounded(X.forward_divergence(s, params, "x", ["m"], [1.0], 5, 20))


@query(f"WITH {DIVERGE} SELECT round(regr_slope(mean_log, s), 6) AS slope FROM c")
def divergence_slope(spark, d):
    s = event_states(spark, d)
    params = s.groupBy("ep").agg(F.avg("x").alias("m"))
    return rounded(X.divergence_slope(X.forward_divergence(s, params, "x", ["m"], [1.0], 5, 20)))


#: Nearest states of matched episodes within three steps of time, from step 3 on, with eight steps more.
MATCHED = f"""{EVENTS}, z AS (SELECT ep, t, x / stddev_pop(x) OVER () AS x FROM states), pr AS (SELECT ep, avg(x) AS m, count(*) AS n FROM states GROUP BY ep),
ab AS (SELECT a.ep AS ep, b.ep AS match, a.n AS n, b.n AS match_n FROM pr a JOIN pr b ON a.ep <> b.ep AND abs(a.m - b.m) <= 0.1 * (SELECT max(m) - min(m) FROM pr)),
nn AS (SELECT ab.ep, x.t, ab.match, y.t AS match_t, row_number() OVER (PARTITION BY ab.ep, x.t ORDER BY round(power(x.x - y.x, 2), 12), ab.match, y.t) AS r
  FROM ab JOIN z x ON x.ep = ab.ep JOIN z y ON y.ep = ab.match AND y.t BETWEEN x.t - 3 AND x.t + 3 WHERE x.t >= 3 AND x.t + 8 < n AND y.t >= 3 AND y.t + 8 < match_n),
c AS (SELECT s, avg(ln(abs(x.x - y.x) + 1e-12)) AS mean_log, count(*) AS n FROM nn, (SELECT unnest(range(9)) AS s) JOIN z x ON x.ep = nn.ep AND x.t = nn.t + s JOIN z y ON y.ep = nn.match AND y.t = nn.match_t + s WHERE r = 1 GROUP BY s)"""


def _matched(spark, d):
    s = event_states(spark, d)
    eps = s.groupBy("ep").agg(F.avg("x").alias("m"), F.count("*").alias("n_steps"))
    return X.matched_divergence(s, eps, ["x"], ["m"], window=3, start=3, steps=8, anchors=None, replicates=50)


@query(f"WITH {MATCHED} SELECT s, round(mean_log, 5) AS mean_log, n FROM c")
def matched_divergence(spark, d):
    return rounded(_matched(spark, d)[0].select(F.col("s").cast("long").alias("s"), "mean_log", "n"), 5)


@query(f"WITH {MATCHED} SELECT round(regr_slope(mean_log, s), 5) AS slope FROM c WHERE s >= 2")
def matched_divergence_slope(spark, d):
    return rounded(_matched(spark, d)[1].select("slope"), 5)


#: Reference windows of the Gram queries, and of those that pair all steps or every episode; every other row is held against them.
REFERENCES, FEW_REFERENCES = 100, 10
GRAM = f"""{LINES}, cap AS (SELECT ep FROM (SELECT DISTINCT ep FROM states) ORDER BY {rank_sql(0)}, ep LIMIT {FEW_REFERENCES}),
g AS (SELECT a.t, a.ep AS i, b.ep AS j, exp(-0.001 * power(a.quantity - b.quantity, 2)) AS k FROM states a JOIN states b ON a.t = b.t WHERE b.ep IN (SELECT ep FROM cap))"""


def _gram(spark, d):
    return X.per_step_gram(line_states(spark, d), ["quantity"], P.Kernel("rbf", gamma=0.001), FEW_REFERENCES)


@query(f"WITH {GRAM} SELECT t, i, j, round(k, 6) AS k FROM g")
def per_step_gram(spark, d):
    return rounded(_gram(spark, d).select("t", "i", "j", "k"))


@query(f"WITH {LINES}, p AS (SELECT a.t, a.ep % 2 = 0 AS a, b.ep % 2 = 0 AS b, exp(-0.001 * power(a.quantity - b.quantity, 2)) AS k FROM states a JOIN states b ON a.t = b.t AND a.ep < b.ep) "
       "SELECT t, round(avg(k) FILTER (a AND b) + avg(k) FILTER (NOT a AND NOT b) - 2 * avg(k) FILTER (a <> b), 6) AS mmd2 FROM (FROM p UNION ALL SELECT DISTINCT t, NULL, NULL, NULL FROM states) GROUP BY t")
def mmd_per_step(spark, d):
    return rounded(X.mmd_per_step(line_states(spark, d), ["quantity"], P.Kernel("rbf", gamma=0.001), F.col("ep") % 2 == 0))


@query(f"WITH {GRAM} SELECT t, i, j, round(sqrt(2 - 2 * k), 5) AS d FROM g")
def kernel_to_distance(spark, d):
    return rounded(X.kernel_distance(_gram(spark, d)), 5)


@query(f"WITH {EVENTS} SELECT e.ep, s.t, sum(CASE WHEN e.fail - s.t = 5 THEN 1 ELSE 0 END)::BIGINT AS label FROM states s JOIN episodes e USING (ep) WHERE s.t % 5 = 0 AND s.t <= e.fail GROUP BY e.ep, s.t")
def labels_at_lead(spark, d):
    s = event_states(spark, d)
    return s.join(event_episodes(s), "ep").filter("t % 5 = 0 and t <= fail").select("ep", "t", (F.col("fail") - F.col("t") == 5).cast("long").alias("label"))


@query(f"""WITH {EVENTS}, l AS (SELECT tau, s.x AS score, (e.fail < e.n_steps)::INT AS label FROM episodes e JOIN (SELECT unnest([1, 3, 5, 10]) AS tau) ON TRUE JOIN states s ON s.ep = e.ep AND s.t = CASE WHEN e.fail < e.n_steps THEN e.fail - tau ELSE e.n_steps - tau END),
r AS (SELECT *, rank() OVER (PARTITION BY tau ORDER BY score) + (count(*) OVER (PARTITION BY tau, score) - 1) / 2.0 AS rk FROM l)
SELECT tau::BIGINT AS tau, round((sum(label * rk) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)), 6) AS auroc FROM r GROUP BY tau""")
def auroc_by_lead_time(spark, d):
    s = event_states(spark, d)
    eps = event_episodes(s).withColumn("tau", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 3, 5, 10)])))
    at = eps.select("ep", "tau", (F.col("fail") - F.col("tau")).alias("t"), (F.col("fail") < F.col("n_steps")).cast("int").alias("label"))
    return rounded(M.auroc(s.join(at, ["ep", "t"]).withColumnRenamed("x", "score"), by=["tau"]).select("tau", "auroc"))


@query(f"WITH {EVENTS} SELECT t, round(quantile_cont(x, 0.9), 6) AS q90, max(x) AS top FROM states GROUP BY t")
def quantile_per_step(spark, d):
    return rounded(event_states(spark, d).groupBy("t").agg(F.percentile("x", F.lit(0.9)).alias("q90"), F.max("x").alias("top")))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, round(m, 6) AS m, r::BIGINT AS r FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m, rank() OVER (PARTITION BY l_returnflag ORDER BY avg(l_quantity) DESC) AS r FROM lineitem GROUP BY 1, 2)")
def best_of_group(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.avg("l_quantity").alias("m"))
    return rounded(g.withColumn("r", F.rank().over(Window.partitionBy("flag").orderBy(F.desc("m"))).cast("long")))


@query(f"WITH {LINES} SELECT round(corr(price, quantity), 6) AS pearson, round(sqrt(avg(power(ln(1 + price) - ln(1 + quantity), 2))) / stddev_pop(ln(1 + price)), 5) AS rel_rmse FROM states")
def approximation_quality(spark, d):
    s = line_states(spark, d)
    gap = F.log1p("price") - F.log1p("quantity")
    return s.agg(F.round(F.corr("price", "quantity"), 6).alias("pearson"), F.round(F.sqrt(F.avg(gap * gap)) / F.stddev_pop(F.log1p("price")), 5).alias("rel_rmse"))


@query(f"WITH {EVENTS} SELECT round((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / abs(median(x)), 6) AS spread, round(quantile_cont(x, 0.95) / avg(x), 6) AS p95_ratio FROM states")
def score_spread(spark, d):
    s = event_states(spark, d)
    low, middle, high, top = M.quantiles(s, "x", [0.25, 0.5, 0.75, 0.95])
    return rounded(s.agg(F.lit((high - low) / abs(middle)).alias("spread"), (top / F.avg("x")).alias("p95_ratio")))


@query(f"WITH {LINES}, st AS (SELECT ep, t, quantity - lag(quantity) OVER w AS a, tax * 100 - lag(tax * 100) OVER w AS b FROM states WINDOW w AS (PARTITION BY ep ORDER BY t)), c AS (SELECT avg(a * a) v, avg(a * b) c, avg(b * b) w FROM st WHERE a IS NOT NULL) "
       "SELECT ep, round(avg(sqrt((w * a * a - 2 * c * a * b + v * b * b) / (v * w - c * c))), 5) AS len FROM st, c WHERE a IS NOT NULL GROUP BY ep")
def mahalanobis_step_length(spark, d):
    s = line_states(spark, d).select("ep", "t", "quantity", (F.col("tax") * 100).alias("tax"))
    cov, _ = R.whitener(s, ["quantity", "tax"])
    inv = np.linalg.inv(cov)
    a, b = F.col("a"), F.col("b")
    steps = s.select("ep", W.difference("quantity").alias("a"), W.difference("tax").alias("b")).filter("a is not null")
    quad = float(inv[0, 0]) * a * a + 2 * float(inv[0, 1]) * a * b + float(inv[1, 1]) * b * b
    return rounded(steps.groupBy("ep").agg(F.avg(F.sqrt(quad)).alias("len")), 5)


@query(f"WITH {EVENTS} SELECT ep, t, round(x - 3, 6) AS biased, round(t / 20.0, 6) AS seconds, row_number() OVER (PARTITION BY ep ORDER BY t) - 1 + ep * 1000 AS flat_index FROM states WHERE t % 3 = 0")
def flat_window_index(spark, d):
    s = event_states(spark, d).filter("t % 3 = 0")
    return rounded(s.select("ep", "t", (F.col("x") - 3).alias("biased"), (F.col("t") / 20.0).alias("seconds"), (F.row_number().over(W.steps()) - 1 + F.col("ep") * 1000).cast("long").alias("flat_index")))


@query("WITH o AS (SELECT o_custkey AS ep, list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS r FROM orders GROUP BY 1) SELECT ep, i - 1 AS t, r[i] AS reward, round(list_sum(r[1:i]), 2) AS total FROM (SELECT ep, r, unnest(range(1, len(r) + 1)) AS i FROM o)")
def rewards_to_long(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ep")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("r"))
    long = o.select("ep", F.posexplode("r").alias("t", "s")).select("ep", F.col("t").cast("long").alias("t"), F.col("s.o_totalprice").alias("reward"))
    return long.withColumn("total", F.round(F.sum("reward").over(W.steps()), 2))


@query(f"WITH {EVENTS}, n AS (SELECT ep, k, round((n_steps - 1) / 2.0 * (1 + cos(pi() * k / 8)), 9) AS node FROM episodes, generate_series(0, 8) g(k)) "
       "SELECT n.ep, n.k, round(node, 6) AS node, ceil(node - 0.5)::BIGINT AS t, s.x FROM n JOIN states s ON s.ep = n.ep AND s.t = ceil(node - 0.5)")
def chebyshev_nodes(spark, d):
    """The state nearest to each Chebyshev node of every episode."""
    s = event_states(spark, d)
    nodes = spark.createDataFrame([(k, float(v)) for k, v in enumerate(B.chebyshev_nodes(8))], "k long, u double")
    last = event_episodes(s).select("ep", (F.col("n_steps") - 1).alias("last"))
    asked = last.crossJoin(F.broadcast(nodes)).select("ep", "k", F.round(F.col("last") / 2 * (1 + F.col("u")), 9).alias("t"))  # nine nodes an episode
    near = W.nearest_in_order(asked, s.select("ep", F.col("t").cast("double").alias("t")), "t", "ep")
    picked = near.select("ep", "k", F.col("t").alias("node"), F.col("nearest_t").cast("long").alias("t"))
    return rounded(picked.join(s.select("ep", "t", "x"), ["ep", "t"]).select("ep", "k", "node", "t", "x"))


@query("""WITH u AS (SELECT l_discount * 10 - avg(l_discount * 10) OVER () AS u FROM lineitem), m AS (SELECT stddev_pop(u) AS s, max(abs(u)) AS r FROM u)
SELECT k::BIGINT AS k, (SELECT round(avg(power(u, k)), 6) FROM u) AS empirical, round(CASE WHEN k % 2 = 1 THEN 0 WHEN k = 0 THEN 1 WHEN k = 2 THEN power(s, 2) WHEN k = 4 THEN 3 * power(s, 4) ELSE 15 * power(s, 6) END::DOUBLE, 6) AS gaussian,
round(CASE WHEN k % 2 = 1 THEN 0.0 ELSE power(r, k) / (k + 1) END::DOUBLE, 6) AS ball FROM generate_series(0, 6) g(k), m""")
def analytic_moments(spark, d):
    """Moments of a column beside those of a normal variable of its deviation and of an interval of its reach."""
    x = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("x"))
    mean = x.agg(F.avg("x")).first()[0]
    u = F.col("x") - mean
    row = x.agg(F.stddev_pop("x"), F.max(F.abs(u)), *[F.avg(F.pow(u, F.lit(k))) for k in range(7)]).first()
    return spark.createDataFrame([(k, round(row[2 + k], 6) + 0.0, round(B.gaussian_moment(k, row[0]), 6), round(B.ball_moment((k,), row[1]), 6)) for k in range(7)], "k long, empirical double, gaussian double, ball double")


@query(f"WITH {EVENTS} SELECT a.ep, a.t AS k, round(sum((exp(-abs(a.t - b.t) / 4.0) + exp(-power(a.t - b.t, 2) / 18.0) * exp(-2 * power(sin(pi() * (a.t - b.t) / 5.0), 2))) * b.x), 5) AS y FROM states a JOIN states b ON a.ep = b.ep GROUP BY a.ep, a.t")
def temporal_kernels(spark, d):
    """Every episode weighted by a composed temporal kernel at each of its steps."""
    s = event_states(spark, d)
    steps = s.agg(F.max("t")).first()[0] + 1
    k = K.TemporalKernel.of("matern12", 4.0) + K.TemporalKernel.of("rbf", 3.0) * K.TemporalKernel.of("periodic", 1.0, 5.0)
    y = B.coefficients(s, "x", k.matrix(np.arange(float(steps)))).withColumnRenamed("coef", "y")
    return rounded(y.join(s.select("ep", F.col("t").alias("k")), ["ep", "k"]), 5)


#: Steps of a window of the trajectory kernels.
STEPS = 30


def _against_some(spark, d, fit, references=REFERENCES):
    """(i, j, k) of every whole window i against the reference windows j; ``fit`` makes the kernel from the reference."""
    cuts = S.windows(line_states(spark, d), STEPS)
    cuts = cuts.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("t", (F.col("quantity") / 10).alias("a"), (F.col("discount") * 20).alias("b")))).alias("w"))
    flat = cuts.filter(F.size("w") == STEPS).select("ep", F.flatten(F.transform("w", lambda s: F.array(s["a"], s["b"]))).alias("w"))
    ids, ref = P.reference(flat, "w", "ep", references)
    cube = lambda z: z.reshape(len(z), STEPS, 2)
    kernel = fit(cube(ref))
    rows = P.against(flat, "w", "ep", lambda _, block: {"k": list(kernel(cube(block)))}, "k array<double>")
    names = F.array(*[F.lit(int(i)) for i in ids]).cast("array<long>")
    return rows.select(F.col("ep").alias("i"), F.posexplode("k").alias("p", "k")).select("i", names[F.col("p")].alias("j"), "k")


CUTS = f"""{LINES}, cuts AS (SELECT ep * 100000 + t // {STEPS} AS ep, t % {STEPS} AS t, quantity / 10 AS a, discount * 20 AS b FROM states), eps AS (SELECT ep FROM cuts GROUP BY ep HAVING count(*) = {STEPS}),
p AS (SELECT * FROM cuts WHERE ep IN (SELECT ep FROM eps)), cap AS (SELECT ep FROM eps ORDER BY {rank_sql(0)}, ep LIMIT {REFERENCES})"""
FEW_CUTS = CUTS.replace(f"LIMIT {REFERENCES})", f"LIMIT {FEW_REFERENCES})")


@query(f"WITH {CUTS} SELECT x.ep AS i, y.ep AS j, round(sum(exp(-0.5 * (power(x.a - y.a, 2) + power(x.b - y.b, 2)))), 6) AS k FROM p x JOIN p y ON x.t = y.t WHERE y.ep IN (SELECT ep FROM cap) GROUP BY 1, 2")
def sum_kernel(spark, d):
    return rounded(_against_some(spark, d, lambda ref: lambda x: K.sum_kernel(x, ref, P.Kernel("rbf", gamma=0.5))))


SPATIOTEMPORAL = f"WITH {FEW_CUTS} SELECT x.ep AS i, y.ep AS j, round(sum(exp(-power(x.t - y.t, 2) / 18.0) * exp(-0.5 * (power(x.a - y.a, 2) + power(x.b - y.b, 2)))), 5) AS k FROM p x, p y WHERE y.ep IN (SELECT ep FROM cap) GROUP BY 1, 2"


@query(SPATIOTEMPORAL)
def spatiotemporal_kernel(spark, d):
    t = K.TemporalKernel.of("rbf", 3.0).matrix(np.arange(float(STEPS)))
    return rounded(_against_some(spark, d, lambda ref: lambda x: K.spatiotemporal(x, ref, t, P.Kernel("rbf", gamma=0.5)), FEW_REFERENCES), 5)


SEQUENCE = f"""WITH {FEW_CUTS}, pr AS (SELECT e.ep AS i, c.ep AS j FROM eps e, cap c UNION SELECT ep, ep FROM eps),
g AS (SELECT i, j, x.t AS s, y.t AS t, exp(-0.5 * (power(x.a - y.a, 2) + power(x.b - y.b, 2))) AS k FROM pr JOIN p x ON x.ep = i JOIN p y ON y.ep = j),
r AS (SELECT *, sum(k) OVER (PARTITION BY i, j, s ORDER BY t DESC) AS row_tail FROM g), q AS (SELECT *, sum(row_tail) OVER (PARTITION BY i, j, t ORDER BY s DESC) AS tail FROM r),
raw AS (SELECT i, j, 0.5 + avg(k * (0.5 + tail / 1800)) / 2 AS v FROM q GROUP BY i, j)
SELECT a.i, a.j, round(greatest(-1, least(1, a.v / sqrt(b.v * c.v))), 6) AS k FROM raw a JOIN raw b ON b.i = a.i AND b.j = a.i JOIN raw c ON c.i = a.j AND c.j = a.j WHERE a.j IN (SELECT ep FROM cap)"""


@query(SEQUENCE)
def signature_kernel(spark, d):
    return rounded(_against_some(spark, d, lambda ref: lambda x: R.sequence_kernel(x, ref, P.Kernel("rbf", gamma=0.5), 2), FEW_REFERENCES))


def _of_features(spark, d, fit):
    """RBF of the features of every window, over both channels, against those of the reference windows; gamma by their median distance."""

    def kernel(ref):
        features = fit(ref)
        own = features(ref)
        rbf = P.Kernel("rbf", gamma=P.bandwidth(own, "rbf", "median"))
        return lambda x: rbf(features(x), own)

    return _against_some(spark, d, kernel)


@query()
def convolution_kernel(spark, d):
    return _of_features(spark, d, lambda ref: K.convolution_map(ref, 9996))


@query()
def scattering_kernel(spark, d):
    return _of_features(spark, d, lambda ref: K.Scattering(ref.shape[1]))


COMPOSITE = f"""WITH {CUTS}, q AS (SELECT x.ep AS i, y.ep AS j, sum(power(x.a - y.a, 2)) AS da, sum(power(x.b - y.b, 2)) AS db FROM p x JOIN p y ON x.t = y.t WHERE y.ep IN (SELECT ep FROM cap) GROUP BY 1, 2),
g AS (SELECT 1 / median(da) FILTER (da > 0) AS ga, 1 / median(db) FILTER (db > 0) AS gb FROM q WHERE i < j AND i IN (SELECT ep FROM cap)) SELECT i, j, round(exp(-ga * da - gb * db), 6) AS k FROM q, g"""


@query(COMPOSITE)
def composite_kernel(spark, d):
    groups = [list(range(0, 2 * STEPS, 2)), list(range(1, 2 * STEPS, 2))]  # a channel each

    def kernel(ref):
        flat = ref.reshape(len(ref), -1)
        both = K.composite(list(zip(groups, K.fit_gammas(flat, groups), strict=True)))
        return lambda x: both(x.reshape(len(x), -1), flat)

    return rounded(_against_some(spark, d, kernel))


@query()
def mean_embedding(spark, d):
    e = K.mean_embedding(line_states(spark, d).select("ep", "t", (F.col("quantity") / 10).alias("quantity")), ["quantity"], 0.5, 64)
    return e.select("ep", F.aggregate("phi", F.lit(0.0), lambda a, p: a + p * p).alias("norm2"))


@query()
def polynomial_sketch(spark, d):
    return R.map_vectors(vectors(spark, d), "v", lambda x: K.count_sketch(x, 2, 128), "phi").select("vec_id", F.col("phi")[0].alias("phi0"))


@query()
def pca_then_cd(spark, d):
    v = vectors(spark, d)
    z = R.PCA.fit(v.filter("label < 5"), "v", 2).transform(v, "v").select("vec_id", "label", F.col("z")[0].alias("a"), F.col("z")[1].alias("b"))
    return D.CDPolynomial.fit(z.filter("label < 5"), ["a", "b"], 2, "hermite", 1e-9).score(z).select("vec_id", "label", "score")


@query()
def pca_of_spectra(spark, d):
    spec = S.spectrum(S.windows(line_states(spark, d), 64), "quantity", 64).groupBy("ep").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mag"))), lambda s: F.log1p(s["mag"])).alias("v"))
    return R.PCA.fit(spec, "v", 3).transform(spec, "v", whiten=True).select("ep", *[F.abs(F.col("z")[i]).alias(f"z{i}") for i in range(3)])


@query()
def kernel_spectrum_rank(spark, d):
    _, x = P.reference(vectors(spark, d), "v", "vec_id", FIT_ROWS)
    share, rank = R.spectrum_rank(P.Kernel("rbf", gamma=0.5)(x, x), 0.05)
    return spark.createDataFrame([(i + 1, float(s), rank) for i, s in enumerate(share[:40])], "r long, captured double, rank95 long")


@query()
def leave_one_out_sweep(spark, d):
    _, x = P.reference(vectors(spark, d), "v", "vec_id", FIT_ROWS)
    rows = [(g, *D.loo_objective(P.Kernel("rbf", gamma=g)(x, x), 1e-2)) for g in (0.1, 0.5, 1.0, 2.0)]
    return spark.createDataFrame(rows, "gamma double, loo double, logdet double")


@query()
def fit_size_sweep(spark, d):
    v = vectors(spark, d).withColumn("y", (F.col("label") >= 5).cast("int"))
    out = None
    for n in (50, 200, FIT_ROWS):
        s = D.KernCD.fit(v.filter("label < 5"), "v", "vec_id", "rbf", lam=1e-3, n=n).score(v, "v")
        row = M.auroc(s, "y").select(F.lit(n).cast("long").alias("n"), "auroc")
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH g AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), m AS (SELECT avg(a * a + b * b) AS level FROM g), p AS (SELECT a, b FROM g, m WHERE a * a + b * b <= level), q AS (SELECT a, b FROM g, m WHERE a * a + 2 * b * b <= level),
f AS (SELECT max(d) AS d FROM (SELECT p.a, p.b, min(sqrt(power(p.a - q.a, 2) + power(p.b - q.b, 2))) AS d FROM p, q GROUP BY p.a, p.b)), r AS (SELECT max(d) AS d FROM (SELECT q.a, q.b, min(sqrt(power(p.a - q.a, 2) + power(p.b - q.b, 2))) AS d FROM p, q GROUP BY q.a, q.b))
SELECT round(greatest(f.d, r.d), 6) AS hausdorff, round((SELECT avg((a * a + b * b > level)::INT) FROM g, m WHERE a * a + 2 * b * b <= level), 6) AS outside FROM f, r""")
def level_set_distance(spark, d):
    g = vectors(spark, d).select("vec_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    g = g.withColumns({"s": F.col("a") * F.col("a") + F.col("b") * F.col("b"), "r": F.col("a") * F.col("a") + 2 * F.col("b") * F.col("b")})
    level = g.agg(F.avg("s")).first()[0]
    return rounded(spark.createDataFrame([X.level_set_distance(g, ["a", "b"], "s", level, "r", level)], "hausdorff double, outside double"))


@query("""WITH e AS (SELECT user_id AS ep, value AS x FROM events), s AS (SELECT ep % 7 AS seed, CASE WHEN ep % 2 = 0 THEN 'even' ELSE 'odd' END AS method, avg(x) AS v FROM e GROUP BY 1, 2)
SELECT a.method, sum((a.v - b.v > 0.01)::BIGINT)::BIGINT AS win, sum((abs(a.v - b.v) <= 0.01)::BIGINT)::BIGINT AS tie, sum((a.v - b.v < -0.01)::BIGINT)::BIGINT AS loss FROM s a JOIN s b USING (seed) WHERE a.method <> 'odd' AND b.method = 'odd' GROUP BY 1""")
def win_tie_loss(spark, d):
    s = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("seed"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("method")).agg(F.avg("value").alias("v"))
    return M.tally(s, ["seed"], "method", "v", "odd")


@query(f"WITH {EVENTS} SELECT s.ep, s.t, round(s.x + 3, 6) AS biased, round(s.x * 0.5, 6) AS weak, round(coalesce(lag(s.x, 2) OVER (PARTITION BY s.ep ORDER BY s.t), 0) * 0.5 + 3, 6) AS both FROM states s")
def composite_disturbance(spark, d):
    s = event_states(spark, d)
    both = E.composite(s, "x", [lambda c: E.delay(c, 2), lambda c: E.degrade(c, 0.5), lambda c: E.bias(c, 3.0)]).select("ep", "t", F.col("x").alias("both"))
    return rounded(s.select("ep", "t", E.bias("x", 3.0).alias("biased"), E.degrade("x", 0.5).alias("weak")).join(both, ["ep", "t"]))


@query(f"WITH {EVENTS}, later AS (SELECT ep, n_steps + 3 AS fail, n_steps + 9 AS n_steps FROM episodes WHERE ep % 2 = 0) SELECT e.ep, CASE WHEN e.fail = e.n_steps THEN coalesce(l.fail, e.fail) ELSE e.fail END AS fail, CASE WHEN e.fail = e.n_steps THEN coalesce(l.n_steps, e.n_steps) ELSE e.n_steps END AS n_steps FROM episodes e LEFT JOIN later l USING (ep)")
def continued_survivors(spark, d):
    e = event_episodes(event_states(spark, d))
    later = e.filter("ep % 2 = 0").select("ep", (F.col("n_steps") + 3).alias("fail"), (F.col("n_steps") + 9).alias("n_steps"))
    return E.continue_survivors(e, later).select("ep", "fail", "n_steps")


@query(f"WITH {EVENTS}, l AS (SELECT tau, s.x AS score, (e.fail < e.n_steps)::INT AS label FROM episodes e JOIN (SELECT unnest([1, 5, 20]) AS tau) ON TRUE JOIN states s ON s.ep = e.ep AND s.t = e.fail - tau), r AS (SELECT *, rank() OVER (PARTITION BY tau ORDER BY score) + (count(*) OVER (PARTITION BY tau, score) - 1) / 2.0 AS rk FROM l) "
       "SELECT tau::BIGINT AS tau, sum(label)::BIGINT AS n_pos, CASE WHEN sum(label) >= 30 THEN round((sum(label * rk) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)), 6) END AS auroc FROM r GROUP BY tau")
def auroc_with_enough_positives(spark, d):
    s = event_states(spark, d)
    eps = event_episodes(s).withColumn("tau", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 5, 20)])))
    at = eps.select("ep", "tau", (F.col("fail") - F.col("tau")).alias("t"), (F.col("fail") < F.col("n_steps")).cast("int").alias("label"))
    return rounded(M.auroc_at_leads(s.join(at, ["ep", "t"]).withColumnRenamed("x", "score"), "tau").select("tau", "n_pos", "auroc"))


@query()
def synthetic_points(spark, d):
    """As many points of each kind as there are vectors, with the noise of their first coordinate."""
    from ..sources.tables import make_points

    n, noise = vectors(spark, d).agg(F.count("*"), F.stddev_pop(F.col("v")[0])).first()
    out = None
    for kind in ("blobs", "moons", "spiral", "disc"):
        part = make_points(spark, kind, n, noise or 0.1).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("reach"), F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def mixture_components(spark, d):
    v = R.PCA.fit(vectors(spark, d), "v", 2).transform(vectors(spark, d), "v")
    return R.gaussian_mixture(v.select("vec_id", "z"), "z", 3).groupBy("component").agg(F.count("*").alias("n"))


@query()
def mds_coordinates(spark, d):
    return R.landmark_mds(vectors(spark, d), "v", "vec_id", 2, 300).select("vec_id", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1"))


@query()
def bilinear_errors(spark, d):
    """Windows of four channels on six splines over time, by each strategy and number of directions."""
    w = W.sliding(line_states(spark, d), ["quantity", "price", "discount", "tax"], 20, 20)
    scale = np.array([1 / 50, 1 / 1e5, 10, 10])
    w = Written(spark, "bilinear").keep(w.select(F.flatten(F.transform("w", lambda s: F.array(*[s[i] * float(scale[i]) for i in range(4)]))).alias("w")))  # nine fits read it
    basis, rows = B.temporal_matrix("bspline", 20, 6), []
    for strategy in ("space_first", "time_first", "joint"):
        for k in (1, 2, 3):
            e = R.BilinearEncoder.fit(w, "w", basis, k, strategy)
            rows.append((strategy, k, e.error, len(e.errors) - 1))
    return spark.createDataFrame(rows, "strategy string, directions int, error double, rounds int")


@query(f"WITH {LINES}, g AS (SELECT ep % 3 AS seed, (discount >= 0.05)::INT AS label, quantity AS score FROM states) SELECT seed, round(avg(CASE WHEN label = 1 THEN (score > 40)::INT::DOUBLE END), 6) AS tpr, round(avg(CASE WHEN label = 0 THEN (score <= 40)::INT::DOUBLE END), 6) AS tnr FROM g GROUP BY seed")
def rates_per_seed(spark, d):
    g = line_states(spark, d).select((F.col("ep") % 3).alias("seed"), (F.col("discount") >= 0.05).alias("label"), (F.col("quantity") > 40).alias("hit"))
    return rounded(g.groupBy("seed").agg(F.avg(F.when(F.col("label"), F.col("hit").cast("double"))).alias("tpr"), F.avg(F.when(~F.col("label"), (~F.col("hit")).cast("double"))).alias("tnr")))


@query(f"WITH {EVENTS}, p AS (SELECT ep, t, x - avg(x) OVER (PARTITION BY ep ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM states) SELECT ep, round(max(abs(d)), 6) AS top FROM p GROUP BY ep")
def running_mean_deviation(spark, d):
    w = W.steps().rowsBetween(Window.unboundedPreceding, 0)
    p = event_states(spark, d).select("ep", (F.col("x") - F.avg("x").over(w)).alias("d"))
    return rounded(p.groupBy("ep").agg(F.max(F.abs("d")).alias("top")))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, {split_sql(3)}, m AS (SELECT s.ep, s.t, p.split, s.x, avg(s.x) FILTER (p.split = 'train') OVER () AS a, stddev_pop(s.x) FILTER (p.split = 'train') OVER () AS b FROM states s JOIN split p USING (ep) WHERE p.split IS NOT NULL) SELECT ep, t, split, round((x - a) / b, 6) AS x FROM m")
def split_and_normalized(spark, d):
    s = event_states(spark, d)
    return rounded(T.split_and_normalize(s, event_episodes(s), ["x"], experiment.SIZES, ("train", "norm", "cal"), seed=3)[0].select("ep", "t", "split", "x"))


@query(f"WITH {EVENTS}, r AS (SELECT ep, ('0x' || substr({rank_sql(5)}, 1, 8))::BIGINT AS h, least(fail - 4, n_steps - 1) - 5 AS last FROM episodes) SELECT ep, h % (last + 1) AS start, h % (last + 1) + 5 AS \"end\" FROM r WHERE last >= 0")
def random_windows_before(spark, d):
    """Windows that end at least four steps before the failure."""
    return W.random_window(event_episodes(event_states(spark, d)), 6, 5, before=4)


PROJECTIONS = f"""WITH {LINES}, c AS (SELECT ep * 100000 + t // 32 AS ep, t % 32 / 31.0 AS u, quantity AS x FROM states), k AS (SELECT unnest([0, 1, 2]) AS k)
SELECT 'gaussian' AS basis, ep, k::BIGINT AS k, round(sum(x * exp(-0.5 * power((u - k / 2.0) * 3, 2))), 5) AS proj FROM c, k GROUP BY ep, k
UNION ALL SELECT 'vonmises', ep, k, round(sum(x * exp(10 * (cos(2 * pi() * (u - k / 3.0)) - 1))), 5) FROM c, k GROUP BY ep, k
UNION ALL SELECT 'fourier', ep, k, round(sum(x * CASE k WHEN 0 THEN 1 WHEN 1 THEN sin(2 * pi() * u) ELSE cos(2 * pi() * u) END), 5) FROM c, k GROUP BY ep, k"""


@query(PROJECTIONS)
def temporal_projections(spark, d):
    cuts, out = S.windows(line_states(spark, d), 32), None
    for kind in ("gaussian", "vonmises", "fourier"):
        part = B.coefficients(cuts, "quantity", B.temporal_matrix(kind, 32, 3).T).select(F.lit(kind).alias("basis"), "ep", "k", F.col("coef").alias("proj"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


#: Threshold families of survivors with even ids, then how often each alarms on the others.
RATES = f"""WITH {EVENTS}, c AS (SELECT s.t, s.x FROM states s JOIN episodes e USING (ep) WHERE ep % 2 = 0 AND fail = n_steps), m AS (SELECT median(x) AS m FROM c), q AS (SELECT quantile_cont(x, 0.9) AS q FROM c GROUP BY t),
r AS (SELECT 'pooled' AS family, quantile_cont(x, 0.9) AS threshold FROM c UNION ALL SELECT 'per_step_mean', avg(q) FROM q UNION ALL SELECT 'per_step_max', max(q) FROM q UNION ALL SELECT 'gaussian', avg(x) + 1.2815515655446004 * stddev_pop(x) FROM c
UNION ALL SELECT 'robust', (SELECT m FROM m) + 3 * 1.4826 * median(abs(x - (SELECT m FROM m))) FROM c), p AS (SELECT ep, fail, n_steps, max(x) AS top FROM states JOIN episodes USING (ep) WHERE ep % 2 = 1 AND t < fail GROUP BY ALL)
SELECT family, round(avg((top > threshold)::INT) FILTER (fail = n_steps), 6) AS fpr, round(avg((top > threshold)::INT) FILTER (fail < n_steps), 6) AS detection_rate FROM p, r GROUP BY family"""


@query(RATES)
def alarm_rates_by_family(spark, d):
    s = event_states(spark, d)
    eps = event_episodes(s)
    scores = s.select("ep", F.col("t").alias("end"), F.col("x").alias("score"))
    calm = scores.filter("ep % 2 = 0").join(E.survived(eps).select("ep"), "ep", "left_semi")
    return rounded(M.alarm_rates(scores.filter("ep % 2 = 1"), eps, M.thresholds(calm, 0.1)))


@query(f"WITH {EVENTS}, v AS (SELECT s.ep, s.t, e.fail, e.n_steps, s.x / 50 AS a, (s.x - lag(s.x) OVER (PARTITION BY s.ep ORDER BY s.t)) / 50 AS b FROM states s JOIN episodes e USING (ep)), n AS (SELECT *, CASE WHEN t = fail THEN 'failure' WHEN t < fail THEN 'nominal' END AS kind FROM v WHERE b IS NOT NULL), "
       "c AS (SELECT *, avg(a) FILTER (kind = 'nominal') OVER () AS ma, avg(b) FILTER (kind = 'nominal') OVER () AS mb, var_pop(a) FILTER (kind = 'nominal') OVER () AS va, var_pop(b) FILTER (kind = 'nominal') OVER () AS vb, covar_pop(a, b) FILTER (kind = 'nominal') OVER () AS cab FROM n) "
       "SELECT kind, count(*) AS n, round(avg(sqrt((vb * power(a - ma, 2) - 2 * cab * (a - ma) * (b - mb) + va * power(b - mb, 2)) / (va * vb - cab * cab))), 5) AS distance FROM c WHERE kind IS NOT NULL GROUP BY kind")
def mahalanobis_at_failure(spark, d):
    """Mean Mahalanobis distance of states before a failure and at it, by the covariance of the former."""
    s = event_states(spark, d)
    v = s.select("ep", "t", (F.col("x") / 50).alias("a"), (W.difference("x") / 50).alias("b")).filter("b is not null").join(event_episodes(s).select("ep", "fail"), "ep")
    v = v.withColumn("kind", F.when(F.col("t") == F.col("fail"), "failure").when(F.col("t") < F.col("fail"), "nominal")).filter("kind is not null")
    row = v.filter("kind = 'nominal'").agg(F.avg("a"), F.avg("b"), F.var_pop("a"), F.var_pop("b"), F.covar_pop("a", "b")).first()
    inv = np.linalg.inv(np.array([[row[2], row[4]], [row[4], row[3]]]))
    a, b = F.col("a") - row[0], F.col("b") - row[1]
    quad = float(inv[0, 0]) * a * a + 2 * float(inv[0, 1]) * a * b + float(inv[1, 1]) * b * b
    return rounded(v.groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.sqrt(quad)).alias("distance")), 5)


@query(f"WITH {LINES}, m AS (SELECT ep, t, quantity / 10 - avg(quantity / 10) OVER () AS a, tax * 50 - avg(tax * 50) OVER () AS b, var_pop(quantity / 10) OVER () AS v, var_pop(tax * 50) OVER () AS w, covar_pop(quantity / 10, tax * 50) OVER () AS c FROM states), "
       "r AS (SELECT *, 0.5 * atan2(2 * c, v - w) AS o FROM m) SELECT ep, t, round(abs(cos(o) * a + sin(o) * b), 5) AS z0, round(abs(cos(o) * b - sin(o) * a), 5) AS z1 FROM r")
def principal_plane(spark, d):
    """Both principal scores of two channels, but for their signs."""
    v = line_states(spark, d).select("ep", "t", F.array(F.col("quantity") / 10, F.col("tax") * 50).alias("v"))
    z = R.PCA.fit(v, "v", 2).transform(v, "v")
    return rounded(z.select("ep", "t", *[F.abs(F.col("z")[i]).alias(f"z{i}") for i in range(2)]), 5)


#: Two landmarks: squared features and Christoffel scores in closed form.
PAIR = f"""WITH {VECTORS}, l AS (SELECT *, row_number() OVER (ORDER BY {rank_sql(0, 'vec_id')}, vec_id) AS r FROM vectors WHERE label < 5), k AS (SELECT a.vec_id, max(exp(-0.5 * {SQ})) FILTER (b.r = 1) AS p, max(exp(-0.5 * {SQ})) FILTER (b.r = 2) AS q FROM vectors a, l b WHERE b.r <= 2 GROUP BY a.vec_id),
g AS (SELECT exp(-0.5 * {SQ}) AS g FROM l a, l b WHERE a.r = 1 AND b.r = 2)"""


@query(f"{PAIR} SELECT vec_id, round((p * p + q * q - 2 * g * p * q) / (1 - g * g), 6) AS norm2 FROM k, g")
def nystrom_of_two(spark, d):
    _, x = P.reference(vectors(spark, d).filter("label < 5"), "v", "vec_id", 2)
    phi = R.map_vectors(vectors(spark, d), "v", R.nystrom(x, P.Kernel("rbf", gamma=0.5)), "phi")
    return rounded(phi.select("vec_id", F.aggregate("phi", F.lit(0.0), lambda a, p: a + p * p).alias("norm2")))


@query(f"{PAIR} SELECT vec_id, round(1 - (1.2 * (p * p + q * q) - 2 * g * p * q) / (1.44 - g * g), 6) AS score FROM k, g")
def kerncd_of_two(spark, d):
    v = vectors(spark, d)
    return rounded(D.KernCD.fit(v.filter("label < 5"), "v", "vec_id", P.Kernel("rbf", gamma=0.5), lam=0.1, n=2).score(v, "v").select("vec_id", "score"))
