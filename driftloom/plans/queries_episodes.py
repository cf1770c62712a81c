"""Queries: sources, splits, normalization, windows and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import windows as W
from .base import CHANNELS, EVENTS, LIMIT, LINES, event_episodes, event_states, line_states, query, rank_sql, rounded, split_sql, table


@query(f"WITH {EVENTS} SELECT ep, n_steps, fail FROM episodes")
def episodes_fail_index(spark, d):
    return event_episodes(event_states(spark, d))


@query(f"WITH {EVENTS} SELECT count(*) AS n, round(avg(CASE WHEN fail < n_steps THEN 1.0 ELSE 0.0 END), 6) AS prop_failed FROM episodes")
def proportion_failed(spark, d):
    return rounded(E.prop_failed(event_episodes(event_states(spark, d))))


@query(f"WITH {EVENTS} SELECT ep, n_steps FROM episodes WHERE fail = n_steps")
def survivors(spark, d):
    return E.survived(event_episodes(event_states(spark, d))).select("ep", "n_steps")


@query(f"WITH {EVENTS}, p AS (SELECT *, row_number() OVER (ORDER BY {rank_sql(3)}, ep) AS pos, count(*) OVER () AS n FROM episodes) "
       "SELECT ep, CASE WHEN pos <= floor(n * 0.5) THEN 'a' ELSE 'b' END AS split FROM p WHERE pos <= floor(round(n * 0.8, 9))")
def split_fractions(spark, d):
    return E.split_indices(event_episodes(event_states(spark, d)), {"a": 0.5, "b": 0.3}, 3).select("ep", "split")


@query(f"WITH {EVENTS}, p AS (SELECT ep, row_number() OVER (ORDER BY {rank_sql(4)}, ep) AS pos FROM episodes) SELECT ep, CASE WHEN pos <= 5 THEN 'a' ELSE 'b' END AS split FROM p WHERE pos <= 9")
def split_counts(spark, d):
    return E.split_by_counts(event_episodes(event_states(spark, d)), {"a": 5, "b": 4}, 4).select("ep", "split")


@query(f"WITH {EVENTS}, {split_sql()} SELECT ep, fail, split FROM split")
def stratified_split(spark, d):
    eps = event_episodes(event_states(spark, d))
    return E.stratified_split(eps, {"train": 0.4, "norm": 0.2, "cal": 0.2, "test": 0.2}, ("train", "norm", "cal"), 0).select("ep", "fail", "split")


@query(f"WITH {EVENTS} SELECT ep FROM episodes ORDER BY {rank_sql(0)}, ep LIMIT 20")
def fit_set_cap(spark, d):
    return E.subsample(event_episodes(event_states(spark, d)), 20).select("ep")


@query(f"WITH {EVENTS}, c AS (SELECT ep, greatest(n_steps - 5, 0) AS m, fail FROM episodes) SELECT ep, m AS n_steps, greatest(0, least(fail, m)) AS fail, (SELECT count(*) FROM states s WHERE s.ep = c.ep AND s.t < c.m) AS kept FROM c")
def drop_last_steps(spark, d):
    states = event_states(spark, d)
    kept, eps = E.drop_last(states, event_episodes(states), 5)
    counts = kept.groupBy("ep").agg(F.count("*").alias("kept"))
    return eps.join(counts, "ep", "left").select("ep", "n_steps", "fail", F.coalesce("kept", F.lit(0)).alias("kept"))


@query(f"WITH {EVENTS} SELECT ep, least(n_steps, 40) - 10 AS n_steps, least(greatest(fail - 10, 0), least(n_steps, 40) - 10) AS fail FROM episodes")
def truncate_range(spark, d):
    states = event_states(spark, d)
    return E.truncate(states, event_episodes(states), 10, 40)[1]


@query(f"WITH {LINES}, m AS (SELECT ep, t, quantity, price, avg(quantity) FILTER (ep % 2 = 0) OVER () AS a, stddev_pop(quantity) FILTER (ep % 2 = 0) OVER () AS b, avg(price) FILTER (ep % 2 = 0) OVER () AS c, stddev_pop(price) FILTER (ep % 2 = 0) OVER () AS e FROM states) "
       "SELECT ep, t, round((quantity - a) / CASE WHEN b = 0 THEN 1 ELSE b END, 6) AS quantity, round((price - c) / CASE WHEN e = 0 THEN 1 ELSE e END, 6) AS price FROM m")
def channel_zscore(spark, d):
    s = line_states(spark, d).select("ep", "t", "quantity", "price")
    return rounded(E.normalize_channels(s, ["quantity", "price"], F.col("ep") % 2 == 0))


@query(f"WITH {EVENTS}, p AS (SELECT s.ep, s.t, s.x FROM states s JOIN episodes e USING (ep) WHERE s.t = ('0x' || substr({rank_sql(2, 's.ep')}, 1, 8))::BIGINT % e.n_steps) SELECT ep, t, x FROM p")
def one_state_per_episode(spark, d):
    return E.one_state(event_states(spark, d), seed=2)


@query(f"SELECT vec_id, label FROM (SELECT vec_id, label::BIGINT AS label, row_number() OVER (PARTITION BY label ORDER BY {rank_sql(1, 'vec_id')}, vec_id) AS r FROM embeddings) WHERE r <= 5")
def pick_per_class(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return E.pick_per_class(v, "label", 5, 1, "vec_id")


@query(f"WITH {LINES} SELECT CASE WHEN quantity > 45 THEN 'bulk' WHEN discount >= 0.09 THEN 'rebate' WHEN price < 2000 THEN 'small' ELSE 'plain' END AS mode, count(*) AS n FROM states GROUP BY 1")
def failure_modes(spark, d):
    mode = E.classify([(F.col("quantity") > 45, "bulk"), (F.col("discount") >= 0.09, "rebate"), (F.col("price") < 2000, "small")], "plain")
    return line_states(spark, d).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT ep, count(*) AS n FROM states WHERE quantity BETWEEN 5 AND 40 AND discount BETWEEN 0.02 AND 0.08 GROUP BY ep")
def inside_box(spark, d):
    box = E.inside_box(["quantity", "discount"], [5, 0.02], [40, 0.08])
    return line_states(spark, d).filter(box).groupBy("ep").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT ep, t, round(x * 0.8, 6) AS weak, coalesce(lag(x, 3) OVER w, 0) AS late, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS held, "
       "coalesce(last_value(CASE WHEN t % 3 <> 1 THEN x END IGNORE NULLS) OVER (PARTITION BY ep ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS kept, "
       "CASE WHEN t BETWEEN 4 AND 6 THEN 2.0 ELSE 0.0 END::DOUBLE AS push, round(1.5 * sin(2 * 3.141592653589793 * t / 10.0), 6) AS wave FROM states WINDOW w AS (PARTITION BY ep ORDER BY t)")
def disturbances(spark, d):
    s = event_states(spark, d)
    return rounded(s.select("ep", "t", E.degrade("x", 0.8).alias("weak"), E.delay("x", 3).alias("late"), E.latency("x", 2).alias("held"), E.dropout("x", F.col("t") % 3 == 1).alias("kept"),
                            E.impulse(2.0, 4, 3).alias("push"), E.periodic(1.5, 10.0).alias("wave")))


@query(f"WITH {EVENTS}, w AS (SELECT ep, t, list(x) OVER (PARTITION BY ep ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS w FROM states) "
       "SELECT ep, t AS \"end\", round(list_sum(w), 6) AS total, len(w)::BIGINT AS width FROM w WHERE t >= 7 AND (t - 7) % 2 = 0")
def sliding_windows(spark, d):
    w = W.sliding(event_states(spark, d), ["x"], 8, 2)
    return rounded(w.select("ep", "end", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("w").cast("long").alias("width")))


@query(f"WITH {EVENTS} SELECT e.ep, count(*) AS n FROM states s JOIN episodes e USING (ep) WHERE s.t >= 4 AND s.t + 3 < e.fail GROUP BY e.ep")
def id_window_count(spark, d):
    s = event_states(spark, d)
    return W.in_distribution(W.sliding(s, ["x"], 5), event_episodes(s), 3).groupBy("ep").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, r AS (SELECT ep, ('0x' || substr({rank_sql(5)}, 1, 8))::BIGINT AS h, least(fail, n_steps - 1) - 5 AS last FROM episodes) SELECT ep, h % (last + 1) AS start, h % (last + 1) + 5 AS \"end\" FROM r WHERE last >= 0")
def random_windows(spark, d):
    return W.random_window(event_episodes(event_states(spark, d)), 6, 5)


@query(f"WITH {EVENTS}, b AS (SELECT ep, ('0x' || substr({rank_sql(6)}, 1, 8))::BIGINT AS h, CASE WHEN fail < n_steps THEN greatest(fail - 4, 5) ELSE 5 END AS lo, CASE WHEN fail < n_steps THEN fail ELSE n_steps - 1 END AS hi, (fail < n_steps)::BIGINT AS label FROM episodes) "
       "SELECT ep, lo + h % (hi - lo + 1) AS \"end\", label FROM b WHERE hi >= lo")
def labelled_windows(spark, d):
    return W.labelled_window(event_episodes(event_states(spark, d)), 6, 4, 6)


@query(f"WITH {EVENTS} SELECT ep, round(sum(abs(d1)), 5) AS path, round(avg(abs(d3)), 5) AS jerk FROM (SELECT ep, x - lag(x) OVER w AS d1, x - 3 * lag(x) OVER w + 3 * lag(x, 2) OVER w - lag(x, 3) OVER w AS d3 FROM states WINDOW w AS (PARTITION BY ep ORDER BY t)) GROUP BY ep")
def path_length(spark, d):
    s = event_states(spark, d).select("ep", W.difference("x").alias("d1"), W.difference("x", 3).alias("d3"))
    return rounded(s.groupBy("ep").agg(F.sum(F.abs("d1")).alias("path"), F.avg(F.abs("d3")).alias("jerk")), 5)


@query(f"WITH {LINES} SELECT ep, t, round(sqrt(power(quantity - lag(quantity) OVER w, 2) + power(tax - lag(tax) OVER w, 2)), 6) AS norm FROM states WINDOW w AS (PARTITION BY ep ORDER BY t)")
def step_norms(spark, d):
    return rounded(line_states(spark, d).select("ep", "t", W.step_norm(["quantity", "tax"]).alias("norm")))


@query(f"WITH {EVENTS} SELECT ep, t, round(coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w, 0), 6) AS g FROM states WINDOW w AS (PARTITION BY ep ORDER BY t)")
def gradients(spark, d):
    return rounded(event_states(spark, d).select("ep", "t", W.gradient("x").alias("g")))


@query(f"WITH {EVENTS} SELECT ep, t, round(avg(x) OVER (PARTITION BY ep ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS odd, round(avg(x) OVER (PARTITION BY ep ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS even FROM states")
def moving_averages(spark, d):
    return rounded(event_states(spark, d).select("ep", "t", W.moving_average("x", 5).alias("odd"), W.moving_average("x", 4).alias("even")))


@query(f"WITH {EVENTS} SELECT a.ep, a.t, round(sum(0.3 * power(0.7, a.t - b.t) * b.x), 6) AS y FROM states a JOIN states b ON a.ep = b.ep AND b.t <= a.t GROUP BY a.ep, a.t")
def low_pass_filter(spark, d):
    return rounded(W.low_pass(event_states(spark, d), "x", 0.3))


@query(f"WITH {EVENTS} SELECT ep, t, round(sum(x) OVER (PARTITION BY ep ORDER BY t), 5) AS total FROM states")
def cumulative_sum(spark, d):
    return rounded(event_states(spark, d).select("ep", "t", F.sum("x").over(W.steps()).alias("total")), 5)


@query(f"WITH {EVENTS} SELECT ep, min(t) AS t, round(min_by(x, t), 6) AS x FROM states WHERE x > 100 GROUP BY ep")
def first_after_filter(spark, d):
    return rounded(event_states(spark, d).filter("x > 100").groupBy("ep").agg(F.min("t").alias("t"), F.min_by("x", "t").alias("x")))


@query(f"WITH {EVENTS}, f AS (SELECT ep, t, sum((x > 50)::INT) OVER w = 3 AND count(*) OVER w = 3 AS held, lead(x, 2) OVER (PARTITION BY ep ORDER BY t) AS ahead FROM states WINDOW w AS (PARTITION BY ep ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT ep, t, (ahead > 50)::BIGINT AS label FROM f WHERE held AND ahead IS NOT NULL")
def held_label_pairs(spark, d):
    s = event_states(spark, d).select("ep", "t", W.held(F.col("x") > 50, 3).alias("held"), F.lead("x", 2).over(W.steps()).alias("ahead"))
    return s.filter("held and ahead is not null").select("ep", "t", (F.col("ahead") > 50).cast("long").alias("label"))


@query(f"WITH {EVENTS} SELECT s.ep, s.t, e.fail - s.t AS to_fail FROM states s JOIN episodes e USING (ep) WHERE e.fail < e.n_steps AND s.t <= e.fail")
def lead_to_failure(spark, d):
    s = event_states(spark, d)
    return s.join(E.failed(event_episodes(s)).select("ep", "fail"), "ep").filter("t <= fail").select("ep", "t", (F.col("fail") - F.col("t")).alias("to_fail"))


@query(f"WITH {EVENTS} SELECT ep, t, x FROM states WHERE t % 4 = 0")
def regular_downsampling(spark, d):
    return W.downsample(event_states(spark, d), 4)


@query(f"""WITH RECURSIVE {EVENTS}, walk AS (
SELECT ep, t, x, x AS anchor, TRUE AS kept FROM states WHERE t = 0
UNION ALL SELECT s.ep, s.t, s.x, CASE WHEN abs(s.x - w.anchor) >= 60 THEN s.x ELSE w.anchor END, abs(s.x - w.anchor) >= 60 FROM walk w JOIN states s ON s.ep = w.ep AND s.t = w.t + 1)
SELECT w.ep, w.t, w.x FROM walk w JOIN episodes e USING (ep) WHERE w.kept OR w.t = e.n_steps - 1""")
def spatial_downsampling(spark, d):
    return W.downsample_spatial(event_states(spark, d), ["x"], 60.0)


@query()
def rdp_simplification(spark, d):
    return W.downsample_rdp(event_states(spark, d), ["t", "x"], 40.0)


@query(f"WITH {LINES} SELECT * FROM (SELECT ep, t, quantity, round(lead(quantity) OVER (PARTITION BY ep ORDER BY t) - quantity, 6) AS d_quantity FROM states) WHERE d_quantity IS NOT NULL")
def transition_pairs(spark, d):
    return rounded(W.transitions(line_states(spark, d).select("ep", "t", "quantity"), ["quantity"]))


@query(f"""WITH {EVENTS}, n AS (SELECT ep, t AS node FROM states WHERE t % 7 = 3)
SELECT s.ep, s.t, arg_min(n.node, abs(n.node - s.t) * 100000 + n.node)::DOUBLE AS nearest_t FROM states s LEFT JOIN n USING (ep) WHERE s.t % 2 = 0 GROUP BY s.ep, s.t""")
def nearest_node(spark, d):
    s = event_states(spark, d)
    return W.nearest_in_order(s.filter("t % 2 = 0").select("ep", "t"), s.filter("t % 7 = 3").select("ep", "t"), "t", "ep")


@query(f"WITH {EVENTS} SELECT ep, t, x FROM states WHERE ep % 10 = 0 UNION ALL SELECT ep, t, x FROM states WHERE ep % 10 = 1")
def union_of_parts(spark, d):
    s = event_states(spark, d)
    return s.filter("ep % 10 = 0").unionByName(s.filter("ep % 10 = 1"))


@query("SELECT event_type, sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS g0, sum(CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS g1, sum(CASE WHEN user_id % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS g2 FROM events GROUP BY event_type")
def pivot_counts(spark, d):
    e = table(spark, d, "events").withColumn("g", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")))
    return e.groupBy("event_type").pivot("g", ["g0", "g1", "g2"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'other' END AS code FROM events")
def recoded_values(spark, d):
    code = E.classify([(F.col("event_type") == "click", "c"), (F.col("event_type") == "view", "v")], "other")
    return table(spark, d, "events").select("event_type", code.alias("code")).distinct()


@query(f"WITH {EVENTS} SELECT ep FROM episodes e WHERE EXISTS (SELECT 1 FROM states s WHERE s.ep = e.ep AND s.x > {LIMIT}) AND NOT EXISTS (SELECT 1 FROM states s WHERE s.ep = e.ep AND s.x < 0.5)")
def semi_and_anti(spark, d):
    s = event_states(spark, d)
    eps = event_episodes(s).select("ep")
    return eps.join(s.filter(F.col("x") > LIMIT), "ep", "left_semi").join(s.filter("x < 0.5"), "ep", "left_anti")


@query(f"WITH {LINES} SELECT channel, ep, round(avg(v), 6) AS mean FROM (UNPIVOT states ON quantity, price, discount, tax INTO NAME channel VALUE v) GROUP BY channel, ep")
def melted_means(spark, d):
    long = line_states(spark, d).unpivot(["ep", "t"], list(CHANNELS), "channel", "v")
    return rounded(long.groupBy("channel", "ep").agg(F.avg("v").alias("mean")))
