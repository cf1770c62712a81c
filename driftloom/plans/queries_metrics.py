"""Queries: experiments, calibration, detection and classification metrics, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import metrics as M
from ..operators import resampling as U
from ..operators import sequences
from ..operators.detectors import Gaussian
from . import experiment
from .base import CHANNELS, EVENTS, LINES, event_episodes, event_states, line_states, query, rounded, split_sql, table, vectors

W5 = [f"lag(z, {i}) OVER w AS w{4 - i}" for i in range(5)]
#: Scores ``sc`` of the windows outside train, from the mean and deviation at each place of a window, or from the 5 nearest windows of train.
GAUSSIAN = f"""g AS (SELECT {", ".join(f"avg(w{i}) AS m{i}, stddev_pop(w{i}) + 1e-8 AS s{i}" for i in range(5))} FROM fitted),
sc AS (SELECT ep, e, split, fail, n_steps, sqrt({" + ".join(f"power((w{i} - m{i}) / s{i}, 2)" for i in range(5))}) AS score FROM win, g WHERE split <> 'train' AND e >= 4 AND e <= fail)"""
NEAREST = f"""sc AS (SELECT a.ep, a.e, a.split, a.fail, a.n_steps, list_avg(min(sqrt({" + ".join(f"power(a.w{i} - b.w{i}, 2)" for i in range(5))}), 5)) AS score
FROM win a, fitted b WHERE a.split <> 'train' AND a.e >= 4 AND a.e <= a.fail GROUP BY ALL)"""

#: ``thr``: the linear quantile of the greatest scores ``top`` at the conformal level of alpha 0.1.
THRESHOLD = """srt AS (SELECT list_sort(list(m)) AS s, count(*) AS n, least(ceil((count(*) + 1) * 0.9) / count(*), 1.0) * (count(*) - 1) AS pos FROM top),
thr AS (SELECT s[floor(pos)::INT + 1] + (pos - floor(pos)) * (coalesce(s[floor(pos)::INT + 2], s[floor(pos)::INT + 1]) - s[floor(pos)::INT + 1]) AS thr FROM srt)"""


def experiment_sql(scores: str = GAUSSIAN, horizon: int = 0, survival_only: bool = True) -> str:
    return f"""WITH {EVENTS}, {split_sql(survival_only=survival_only)},
m AS (SELECT avg(x) AS a, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS b FROM states JOIN split USING (ep) WHERE split = 'train'),
zs AS (SELECT ep, t, (x - a) / b AS z, split, fail, n_steps FROM states JOIN split USING (ep), m),
win AS (SELECT ep, t AS e, split, fail, n_steps, {", ".join(W5)} FROM zs WINDOW w AS (PARTITION BY ep ORDER BY t)),
fitted AS (SELECT * FROM win WHERE split = 'train' AND e >= 4 AND e + {horizon} < fail),
{scores},
zn AS (SELECT e, avg(score) AS mu, stddev_pop(score) + 1e-8 AS sd FROM sc WHERE split = 'norm' GROUP BY e),
z AS (SELECT sc.*, (score - mu) / sd AS z FROM sc LEFT JOIN zn USING (e)),
top AS (SELECT ep, max(z) AS m FROM z WHERE split = 'cal' GROUP BY ep HAVING max(z) IS NOT NULL),
{THRESHOLD}"""


EXPERIMENT = experiment_sql()
ALARMS = """per AS (SELECT ep, fail, n_steps, max(CASE WHEN z > thr THEN 1 ELSE 0 END) AS fired, min(CASE WHEN z > thr AND e < fail THEN e END) AS early, min(e) AS first_end FROM z, thr WHERE split = 'test' GROUP BY ep, fail, n_steps)"""
METRICS = (f"{ALARMS} SELECT count(CASE WHEN fail = n_steps THEN 1 END) AS n_survived, count(CASE WHEN fail < n_steps AND fail > first_end THEN 1 END) AS n_failed, "
           "round(avg(CASE WHEN fail = n_steps THEN fired::DOUBLE END), 6) AS fpr, round(avg(CASE WHEN fail < n_steps AND fail > first_end THEN (early IS NOT NULL)::INT::DOUBLE END), 6) AS detection_rate, "
           "round(quantile_cont(CASE WHEN fail < n_steps AND fail > first_end THEN (fail - early)::DOUBLE END, 0.5), 6) AS median_lead FROM per")


@query(f"{EXPERIMENT}, {METRICS}")
def run_experiment_gaussian(spark, d):
    s = event_states(spark, d)
    return rounded(experiment.run_experiment(s, event_episodes(s)).metrics)


@query(f"{EXPERIMENT} SELECT ep, e AS \"end\", round(z, 5) AS z FROM z WHERE split = 'test'")
def experiment_scores(spark, d):
    s = event_states(spark, d)
    return rounded(experiment.run_experiment(s, event_episodes(s)).scores.select("ep", "end", "z"), 5)


@query(f"{EXPERIMENT} SELECT round(thr, 5) AS threshold FROM thr")
def max_conformal_threshold(spark, d):
    s = event_states(spark, d)
    return spark.range(1).select(F.round(F.lit(experiment.run_experiment(s, event_episodes(s)).threshold), 5).alias("threshold"))


@query(f"""WITH {EVENTS}, {split_sql()}, c AS (SELECT ep, t, x, split, fail, n_steps, t < n_steps - 5 AS kept FROM states JOIN split USING (ep)), g AS (SELECT avg(x) AS a, stddev_pop(x) + 1e-8 AS b FROM c WHERE split = 'train' AND kept),
sc AS (SELECT c.*, abs(x - a) / b AS score FROM c, g), top AS (SELECT ep, max(score) AS m FROM sc WHERE split = 'cal' AND kept GROUP BY ep), {THRESHOLD},
f AS (SELECT avg(f::DOUBLE) AS fpr FROM (SELECT max((score > thr)::INT) AS f FROM sc, thr WHERE split = 'test' AND fail = n_steps AND kept GROUP BY ep)), l AS (SELECT (fail - min(t) FILTER (score > thr))::DOUBLE AS lead FROM sc, thr WHERE split = 'test' AND fail < n_steps GROUP BY ep, fail)
SELECT round(avg(coalesce(lead > 0, FALSE)::INT::DOUBLE), 6) AS edr, round(quantile_cont(lead, 0.5) FILTER (lead > 0), 6) AS median_lead, count(*) AS n, round(any_value(fpr), 6) AS fpr FROM l, f""")
def survival_benchmark(spark, d):
    s = event_states(spark, d)
    return rounded(experiment.run_survival(s, event_episodes(s), ["x"]).metrics)


def _scores(spark, d):
    """A plain score per step: the value itself, over steps up to the failure."""
    s = event_states(spark, d)
    eps = event_episodes(s)
    return s.select("ep", F.col("t").alias("end"), F.col("x").alias("score")), eps


@query(f"WITH {EVENTS} SELECT t AS \"end\", round(avg(x), 6) AS mean, round(stddev_pop(x) + 1e-8, 6) AS sd FROM states WHERE ep % 2 = 0 GROUP BY t")
def znorm_by_end(spark, d):
    sc, _ = _scores(spark, d)
    return rounded(M.znorm_by_end(sc.filter("ep % 2 = 0")))


@query(f"WITH {EVENTS} SELECT e.ep, e.fail - min(CASE WHEN x > 150 THEN t END) AS lead FROM episodes e JOIN states s USING (ep) WHERE fail < n_steps GROUP BY e.ep, e.fail")
def lead_times(spark, d):
    sc, eps = _scores(spark, d)
    return M.first_alarms(sc, eps, 150.0, "score").filter("failed = 1").select("ep", F.col("signed_lead").alias("lead"))


LEADS = f"{EVENTS}, leads AS (SELECT e.ep, e.fail - min(CASE WHEN x > 150 THEN t END) AS lead FROM episodes e JOIN states s USING (ep) WHERE fail < n_steps GROUP BY e.ep, e.fail)"


@query(f"WITH {LEADS} SELECT \"L\"::BIGINT AS \"L\", round(avg(CASE WHEN lead >= \"L\" THEN 1.0 ELSE 0.0 END), 6) AS rate FROM generate_series(0, 30) g(\"L\"), leads GROUP BY 1")
def incidence_curve(spark, d):
    return rounded(M.incidence_curve(lead_times(spark, d), 30))


@query(f"WITH {LEADS} SELECT round(avg(CASE WHEN lead > 0 THEN 1.0 ELSE 0.0 END), 6) AS edr, round(quantile_cont(CASE WHEN lead > 0 THEN lead::DOUBLE END, 0.5), 6) AS median_lead, count(*) AS n FROM leads")
def edr_and_lead(spark, d):
    return rounded(M.edr_and_lead(lead_times(spark, d)))


@query(f"WITH {LINES} SELECT channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 "
       "FROM (UNPIVOT states ON quantity, price, discount, tax INTO NAME channel VALUE v) GROUP BY channel")
def channel_stats(spark, d):
    return rounded(M.channel_stats(line_states(spark, d), CHANNELS))


LABELLED = "labelled AS (SELECT l_suppkey % 5 AS g, (l_discount >= 0.05)::INT AS label, l_quantity + l_tax * 100 AS score FROM lineitem)"


def _labelled(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 5).alias("g"), (F.col("l_discount") >= 0.05).cast("int").alias("label"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("score"))


RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS rk FROM labelled)"


@query(f"WITH {LABELLED}, {RANKED} SELECT g, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, round((sum(label * rk) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)), 6) AS auroc FROM r GROUP BY g")
def auroc_by_group(spark, d):
    return rounded(M.auroc(_labelled(spark, d), by=["g"]))


CURVE = f"""{LABELLED}, c AS (SELECT score AS s, sum(label) AS p, sum(1 - label) AS n FROM labelled GROUP BY score),
roc AS (SELECT s, sum(p) OVER w / (sum(p) OVER ()) AS tpr, sum(n) OVER w / (sum(n) OVER ()) AS fpr, sum(p) OVER w / (sum(p) OVER w + sum(n) OVER w) AS prec FROM c WINDOW w AS (ORDER BY s DESC))"""


@query(f"WITH {CURVE}, pts AS (SELECT fpr, min(tpr) AS lo, max(tpr) AS tpr FROM (SELECT fpr, tpr FROM roc UNION ALL SELECT 0.0, 0.0) GROUP BY fpr), seg AS (SELECT *, lag(fpr) OVER (ORDER BY fpr) AS f0, lag(tpr) OVER (ORDER BY fpr) AS t0 FROM pts) "
       "SELECT round(CASE WHEN fpr = 0.05 THEN tpr ELSE t0 + (lo - t0) * (0.05 - f0) / (fpr - f0) END, 6) AS tpr FROM seg WHERE fpr >= 0.05 AND coalesce(f0, -1) < 0.05")
def tpr_at_fpr(spark, d):
    return rounded(M.tpr_at_fpr(_labelled(spark, d), 0.05))


@query(f"WITH {CURVE} SELECT round(max(prec), 6) AS precision FROM roc WHERE tpr >= 0.8")
def precision_at_recall(spark, d):
    return rounded(M.precision_at_recall(_labelled(spark, d), 0.8))


@query(f"WITH {CURVE}, seg AS (SELECT tpr, prec, coalesce(lag(tpr) OVER w, 0) AS r0, coalesce(lag(prec) OVER w, 1) AS p0 FROM roc WINDOW w AS (ORDER BY tpr, s DESC)) SELECT round(sum((tpr - r0) * (prec + p0) / 2), 6) AS pr_auc FROM seg")
def pr_auc(spark, d):
    return rounded(M.pr_auc(_labelled(spark, d)))


@query(f"WITH {LABELLED} SELECT label::BIGINT AS label, (score > 30)::BIGINT AS predicted, count(*) AS n FROM labelled GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return M.confusion(_labelled(spark, d), 30.0)


@query(f"WITH {LABELLED}, k AS (SELECT score AS v, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM labelled WHERE g IN (0, 1) GROUP BY score) SELECT round(max(abs(fa - fb)), 6) AS ks FROM (SELECT sum(a) OVER w / (sum(a) OVER ()) AS fa, sum(b) OVER w / (sum(b) OVER ()) AS fb FROM k WINDOW w AS (ORDER BY v))")
def ks_statistic(spark, d):
    return rounded(M.ks_statistic(_labelled(spark, d), "score", "g", 0, 1))


@query(f"WITH {LINES} SELECT least(floor((quantity - 0) / 5), 9)::BIGINT AS bin, count(price) AS n, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS sd, round(stddev_pop(price) / sqrt(count(price)), 4) AS se FROM states WHERE quantity BETWEEN 0 AND 50 GROUP BY 1")
def binned_statistic(spark, d):
    return rounded(M.binned(line_states(spark, d), "quantity", "price", 0.0, 5.0, 10), 4)


@query(f"WITH {EVENTS} SELECT floor(log10(x) * 4)::BIGINT AS bin, count(*) AS n, round(avg(t), 6) AS mean, round(quantile_cont(t, 0.25), 6) AS q25, round(quantile_cont(t, 0.75), 6) AS q75 FROM states WHERE x > 0 GROUP BY 1 HAVING count(*) >= 20")
def log_binned_curve(spark, d):
    return rounded(M.log_binned(event_states(spark, d), "x", "t", 4))


@query(f"WITH {EVENTS}, tr AS (SELECT x FROM states WHERE ep % 2 = 0) SELECT ep, t, round((SELECT count(*) FROM tr WHERE tr.x <= s.x) / (SELECT count(*) FROM tr)::DOUBLE, 6) AS percentile FROM states s WHERE ep % 20 = 1")
def percentile_of_train(spark, d):
    s = event_states(spark, d).withColumnRenamed("x", "score")
    return rounded(M.percentile_of(s.filter("ep % 20 = 1"), s.filter("ep % 2 = 0")).select("ep", "t", "percentile"))


@query(f"WITH {EVENTS} SELECT t AS \"end\", count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS sd, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(stddev_pop(x) / avg(x), 6) AS cv FROM states GROUP BY t")
def nonstationarity_profile(spark, d):
    return rounded(M.nonstationarity(_scores(spark, d)[0]))


@query(f"WITH {EVENTS} SELECT e AS \"end\", count(*) AS n FROM (SELECT ep, arg_min(t, -x) AS e FROM states GROUP BY ep) GROUP BY e")
def argmax_histogram(spark, d):
    return M.argmax_steps(_scores(spark, d)[0])


@query(f"WITH {EVENTS}, m AS (SELECT median(x) AS m FROM states) SELECT 'pooled' AS family, round(quantile_cont(x, 0.9), 6) AS threshold FROM states UNION ALL SELECT 'per_step_mean', round(avg(q), 6) FROM (SELECT quantile_cont(x, 0.9) AS q FROM states GROUP BY t) UNION ALL SELECT 'per_step_max', round(max(q), 6) FROM (SELECT quantile_cont(x, 0.9) AS q FROM states GROUP BY t) UNION ALL SELECT 'gaussian', round(avg(x) + 1.2815515655446004 * stddev_pop(x), 6) FROM states UNION ALL SELECT 'robust', round(max(m) + 3 * 1.4826 * median(abs(x - m)), 6) FROM states, m")
def threshold_families(spark, d):
    return rounded(M.thresholds(_scores(spark, d)[0], 0.1))


@query(f"WITH {EVENTS} SELECT round(x, 6) AS tau FROM (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM states) WHERE r = least(ceil((n + 1) * 0.9), n)")
def conformal_order_statistic(spark, d):
    tau = M.conformal_order_statistic(_scores(spark, d)[0], 0.1)
    return spark.range(1).select(F.round(F.lit(tau), 6).alias("tau"))


@query(f"WITH {LINES}, c AS (SELECT ep, t, quantity, tax, avg(quantity) FILTER (ep % 2 = 0) OVER () AS a, stddev_pop(quantity) FILTER (ep % 2 = 0) OVER () + 1e-8 AS b, avg(tax) FILTER (ep % 2 = 0) OVER () AS e, stddev_pop(tax) FILTER (ep % 2 = 0) OVER () + 1e-8 AS f FROM states) SELECT ep, t AS \"end\", round(greatest((quantity - a) / b, (tax - e) / f), 6) AS z FROM c")
def or_of_detectors(spark, d):
    s = line_states(spark, d)
    named = {c: s.select("ep", F.col("t").alias("end"), F.col(c).alias("score")) for c in ("quantity", "tax")}
    return rounded(M.or_combination(named, {c: v.filter("ep % 2 = 0") for c, v in named.items()}))


@query(f"WITH {LINES}, m AS (SELECT *, avg(quantity) FILTER (t < 100) OVER () AS a, stddev_pop(quantity) FILTER (t < 100) OVER () + 1e-8 AS b, avg(price) FILTER (t < 100) OVER () AS c, stddev_pop(price) FILTER (t < 100) OVER () + 1e-8 AS e FROM states) SELECT ep, t, round(sqrt(power((quantity - a) / b, 2) + power((price - c) / e, 2)), 6) AS score FROM m")
def gaussian_state_scores(spark, d):
    s = line_states(spark, d).select("ep", "t", "quantity", "price")
    return rounded(Gaussian.fit(s.filter("t < 100"), ["quantity", "price"]).score(s).select("ep", "t", "score"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_quantity), 6) AS mean_l_quantity, round(stddev_pop(l_quantity), 6) AS sd_l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def mean_and_sd_by_keys(spark, d):
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})
    return rounded(M.standardized(li, ["flag", "status"], ["l_quantity"]))


@query()
def bootstrap_auroc(spark, d):
    v = vectors(spark, d).select((F.col("label") < 3).cast("int").alias("label"), F.col("v")[0].alias("score"))
    return U.bootstrap_auroc(v, replicates=500)


@query(f"WITH {EVENTS} SELECT round(avg(CASE WHEN x > q THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT x FROM states WHERE ep % 2 = 1), (SELECT quantile_cont(x, 0.95) AS q FROM states WHERE ep % 2 = 0)")
def share_beyond_train_percentile(spark, d):
    s = event_states(spark, d)
    q = s.filter("ep % 2 = 0").agg(F.percentile("x", F.lit(0.95)).alias("q"))
    return rounded(s.filter("ep % 2 = 1").crossJoin(F.broadcast(q)).agg(F.avg((F.col("x") > F.col("q")).cast("double")).alias("accuracy")))


@query(f"WITH {EVENTS}, {split_sql()} SELECT split, count(*) AS n, count(CASE WHEN fail < n_steps THEN 1 END) AS n_failed, round(avg(fail), 6) AS mean_fail FROM split GROUP BY split")
def fail_step_distribution(spark, d):
    eps = event_episodes(event_states(spark, d))
    s = E.stratified_split(eps, experiment.SIZES, ("train", "norm", "cal"), 0)
    return rounded(s.groupBy("split").agg(F.count("*").alias("n"), F.count(F.when(F.col("fail") < F.col("n_steps"), 1)).alias("n_failed"), F.avg("fail").alias("mean_fail")))


def _deploy(method):
    def run(spark, d):
        s = event_states(spark, d)
        return rounded(experiment.run_experiment(s, event_episodes(s), method=method, horizon=2, survival_only=False).metrics)

    return run


DEPLOYED = {"gaussian": GAUSSIAN, "knn": NEAREST}
for _method in sequences.METHODS:
    query(f"{experiment_sql(DEPLOYED[_method], 2, False)}, {METRICS}" if _method in DEPLOYED else None, f"deploy_{_method}")(_deploy(_method))
