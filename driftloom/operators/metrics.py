"""Calibration, detection metrics, classification quality and two-sample statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to a deviation before it divides.
FLOOR = 1e-8


def slices(df: DataFrame, value: str, n: int = 256) -> DataFrame:
    """``df`` with ``__slice``: rows by ranges of ``value``, cut at approximate quantiles, equal values together; nulls last."""
    cuts = df.filter(F.col(value).isNotNull()).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 50 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    # the cut below a value by bisection: about log2(n) comparisons
    def at(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(value) <= F.lit(cuts[mid]), at(lo, mid)).otherwise(at(mid + 1, hi))

    return df.withColumn("__slice", at(0, len(cuts)))


def running(df: DataFrame, value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """``df`` (one row a value) with ``<c>_run``: sums of c over all rows up to this one in the order of ``value``.

    Counts of slices of the order give what lies before a slice, a window inside the
    slice the rest: no window holds the table.
    """
    cut = slices(df, value)
    side = F.desc if descending else F.asc
    totals = cut.groupBy("__slice").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.partitionBy(F.lit(0)).orderBy(side("__slice")).rowsBetween(Window.unboundedPreceding, -1)  # some hundred slices
    starts = totals.select("__slice", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_before") for c in sums])
    inside = Window.partitionBy("__slice").orderBy(side(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"{c}_run": F.sum(c).over(inside) for c in sums}).join(F.broadcast(starts), "__slice")
    return out.withColumns({f"{c}_run": F.col(f"{c}_run") + F.col(f"__{c}_before") for c in sums}).drop("__slice", *[f"__{c}_before" for c in sums])


def ranked(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``rank`` from 1 in the order of ``value``; equal values in any order, but each its own rank."""
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    run = running(counts, value, ["__n"]).select(value, F.explode(F.sequence(F.col("__n_run") - F.col("__n") + 1, F.col("__n_run"))).alias("rank"))
    return run  # rows of one value are alike but for their rank


def quantiles_of(df: DataFrame, columns: Sequence[str], shares: Sequence[float], n: int = 256) -> dict[str, list[float | None]]:
    """Exact linear quantiles of several columns at once; nulls are skipped.

    Rows become counts of (column, value), cut into slices at approximate quantiles of
    each column.  Ranks come from the slices' sums and a window inside each, and only the
    values at the wanted ranks reach the driver.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v is not null")
    counts = long.groupBy("c", "v").agg(F.count("*").alias("k"))
    cuts = {r["c"]: sorted(set(r["cuts"])) for r in counts.groupBy("c").agg(F.percentile_approx("v", [i / n for i in range(1, n)], 50 * n).alias("cuts")).collect()}
    if not cuts:
        return {c: [None] * len(shares) for c in columns}
    edges = df.sparkSession.createDataFrame(list(cuts.items()), "c string, cuts array<double>")
    cut = counts.join(F.broadcast(edges), "c").select("c", "v", "k", F.size(F.filter("cuts", lambda e: e < F.col("v"))).alias("slice"))
    totals = cut.groupBy("c", "slice").agg(F.sum("k").alias("t"))
    whole, before = Window.partitionBy("c"), Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # some hundred slices
    starts = totals.select("c", "slice", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"), F.sum("t").over(whole).alias("n"))
    run = cut.join(F.broadcast(starts), ["c", "slice"]).withColumn("run", F.col("start") + F.sum("k").over(Window.partitionBy("c", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    holds = F.lit(False)
    for s in shares:
        low = F.floor(F.lit(s) * (F.col("n") - 1) + 1e-12)
        for rank in (low, F.least(low + 1, F.col("n") - 1)):
            holds = holds | ((F.col("run") > rank) & (F.col("run") - F.col("k") <= rank))
    found: dict[str, list] = {}
    for r in run.filter(holds).select("c", "v", "k", "run", "n").collect():
        found.setdefault(r["c"], []).append((r["run"], r["k"], r["v"], r["n"]))
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for c, rows in found.items():
        rows.sort()
        at = lambda rank: next(v for upto, k, v, _ in rows if upto - k <= rank < upto)  # noqa: E731, B023
        for i, s in enumerate(shares):
            place = s * (rows[0][3] - 1)
            low = math.floor(place + 1e-12)
            a, b = at(low), at(min(low + 1, rows[0][3] - 1))
            out[c][i] = float(a + (b - a) * max(place - low, 0.0))
    return out


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact linear quantiles of a column."""
    return quantiles_of(df, [value], shares)[value]


def znorm_by_end(reference: DataFrame) -> DataFrame:
    """(end, mean, sd): moments of the reference scores at each step; nulls are skipped."""
    return reference.groupBy("end").agg(F.avg("score").alias("mean"), (F.stddev_pop("score") + FLOOR).alias("sd"))


def apply_znorm(scores: DataFrame, moments: DataFrame) -> DataFrame:
    """Adds ``z``; null where the reference has no score at that step."""
    return scores.join(moments, "end", "left").withColumn("z", (F.col("score") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def conformal_level(n: int, alpha: float) -> float:
    if n == 0:
        raise ValueError("no calibration episode has a score")
    return min(math.ceil((n + 1) * (1 - alpha)) / n, 1.0)


def max_conformal_threshold(scores: DataFrame, alpha: float, col: str = "z") -> float:
    """Linear quantile of the episodes' greatest scores at the conformal level; two scalars reach the driver."""
    top = scores.groupBy("ep").agg(F.max(col).alias("m")).filter("m is not null")
    return quantiles(top, "m", [conformal_level(top.count(), alpha)])[0]


def conformal_order_statistic(scores: DataFrame, alpha: float, col: str = "score") -> float:
    """The ``min(ceil((n + 1)(1 - alpha)), n)``-th least score, not interpolated."""
    n = scores.filter(F.col(col).isNotNull()).count()
    k = min(math.ceil((n + 1) * (1 - alpha)), n)
    # the k-th least is the exact quantile whose linear position is an integer
    return quantiles(scores, col, [(k - 1) / (n - 1) if n > 1 else 0.0])[0]


def first_alarms(scores: DataFrame, episodes: DataFrame, threshold: float, col: str = "z") -> DataFrame:
    """Per episode: alarms anywhere, first alarm before the failure, signed lead of the first alarm."""
    fired = F.col(col) > F.lit(threshold)
    per = (scores.join(episodes, "ep").groupBy("ep", "fail", "n_steps")
           .agg(F.max(F.coalesce(fired.cast("int"), F.lit(0))).alias("fired"), F.min(F.when(fired & (F.col("end") < F.col("fail")), F.col("end"))).alias("early"),
                F.min(F.when(fired, F.col("end"))).alias("first"), F.min("end").alias("first_end")))
    return per.withColumns({"failed": (F.col("fail") < F.col("n_steps")).cast("int"), "lead": F.col("fail") - F.col("early"), "signed_lead": F.col("fail") - F.col("first")})


def detection_metrics(scores: DataFrame, episodes: DataFrame, threshold: float, col: str = "z") -> DataFrame:
    """One row: FPR over survivors, detection rate over detectable failures, median lead.

    A failure at or before the first scored step can't be detected and doesn't
    count; rates over nothing are null.
    """
    a = first_alarms(scores, episodes, threshold, col)
    detectable = (F.col("failed") == 1) & (F.col("fail") > F.col("first_end"))
    return a.agg(F.count(F.when(F.col("failed") == 0, 1)).alias("n_survived"), F.count(F.when(detectable, 1)).alias("n_failed"),
                 F.avg(F.when(F.col("failed") == 0, F.col("fired").cast("double"))).alias("fpr"),
                 F.avg(F.when(detectable, F.col("early").isNotNull().cast("double"))).alias("detection_rate"),
                 F.percentile(F.when(detectable, F.col("lead")), F.lit(0.5)).alias("median_lead"))


def incidence_curve(leads: DataFrame, longest: int) -> DataFrame:
    """(L, rate): share of failures that were told at least ``L`` steps ahead."""
    # counts per lead first: what is joined to the grid is bounded by it
    hist = leads.groupBy(F.least(F.col("lead"), F.lit(longest)).alias("lead")).agg(F.count("*").alias("n"))
    grid = leads.sparkSession.range(0, longest + 1).select(F.col("id").alias("L"))
    return grid.crossJoin(F.broadcast(hist)).groupBy("L").agg((F.sum(F.when(F.col("lead") >= F.col("L"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))


def edr_and_lead(leads: DataFrame) -> DataFrame:
    """(edr, median_lead, n): early are leads above 0."""
    early = F.col("lead") > 0
    return leads.agg(F.avg(F.coalesce(early, F.lit(False)).cast("double")).alias("edr"), F.percentile(F.when(early, F.col("lead")), F.lit(0.5)).alias("median_lead"), F.count("*").alias("n"))


def channel_stats(states: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(channel, mean, sd, min, max, q25, q50, q75): one pass for the moments, one for the quantiles of all channels."""
    row = states.agg(*[f(c).alias(f"{n}_{c}") for c in channels for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))]).first()
    middle = quantiles_of(states, channels, (0.25, 0.5, 0.75))
    out = [(c, *[None if row[f"{n}_{c}"] is None else float(row[f"{n}_{c}"]) for n in ("mean", "sd", "min", "max")], *middle[c]) for c in channels]
    return states.sparkSession.createDataFrame(out, "channel string, mean double, sd double, min double, max double, q25 double, q50 double, q75 double")


def _by_score(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Counts per distinct score: all curves below run over these, not over rows."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n"))


def auroc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; null without both classes.

    Over the whole table the negatives below a score come from counts of slices, in
    groups from a window of each group.
    """
    c = _by_score(df, label, score, by)
    if by:
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        c, below = running(c, "s", ["n"]), F.col("n_run") - F.col("n")
    pairs = c.withColumn("u", F.col("p") * (below + F.col("n") / 2))
    return pairs.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.try_divide(F.sum("u"), F.sum("p").cast("double") * F.sum("n")).alias("auroc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(s, tpr, fpr, precision) with alarm at ``score >= s``."""
    c = _by_score(df, label, score, by)
    if by:
        down, whole = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
        c = c.withColumns({"p_run": F.sum("p").over(down), "n_run": F.sum("n").over(down), "all_p": F.sum("p").over(whole), "all_n": F.sum("n").over(whole)})
    else:
        c = running(c, "s", ["p", "n"], descending=True).crossJoin(F.broadcast(c.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))))  # one row
    tp, fp = F.col("p_run"), F.col("n_run")
    return c.select(*by, "s", (tp / F.col("all_p")).alias("tpr"), (fp / F.col("all_n")).alias("fpr"), (tp / (tp + fp)).alias("precision"))


def tpr_at_fpr(df: DataFrame, fpr: float, label: str = "label", score: str = "score") -> DataFrame:
    """TPR at a false positive rate, linear between the points of the curve on either side of it: one aggregate over them."""
    points = roc_curve(df, label, score).select("fpr", "tpr").unionByName(df.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double"))
    near, at = F.struct("fpr", "tpr"), F.col("fpr")
    ends = points.agg(F.max(F.when(at < fpr, near)).alias("a"), F.min(F.when(at >= fpr, near)).alias("b"), F.max(F.when(at == fpr, F.col("tpr"))).alias("exact"))
    between = F.col("a.tpr") + (F.col("b.tpr") - F.col("a.tpr")) * (fpr - F.col("a.fpr")) / (F.col("b.fpr") - F.col("a.fpr"))
    return ends.select(F.coalesce("exact", between).alias("tpr"))


def precision_at_recall(df: DataFrame, recall: float, label: str = "label", score: str = "score") -> DataFrame:
    return roc_curve(df, label, score).filter(F.col("tpr") >= recall).agg(F.max("precision").alias("precision"))


def pr_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under precision over recall by trapezoids, from (0, 1); a point's running counts give the point before it."""
    c = _by_score(df, label, score, ())
    run = running(c, "s", ["p", "n"], descending=True).crossJoin(F.broadcast(c.agg(F.sum("p").alias("all_p"))))  # one row
    p, n = F.col("p_run"), F.col("n_run")
    p0, n0 = p - F.col("p"), n - F.col("n")
    before = F.coalesce(F.try_divide(p0, p0 + n0), F.lit(1.0))
    return run.agg(F.sum(F.col("p") / F.col("all_p") * (p / (p + n) + before) / 2).alias("pr_auc"))


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    hit = F.col(score) > threshold
    return df.groupBy(F.col(label).cast("long").alias("label"), F.coalesce(hit, F.lit(False)).cast("long").alias("predicted")).agg(F.count("*").alias("n"))


def binned(df: DataFrame, by: str, value: str, low: float, width: float, bins: int) -> DataFrame:
    """Mean, deviation, count and standard error of ``value`` in equal bins of ``by``."""
    b = F.least(F.floor((F.col(by) - low) / width), F.lit(bins - 1)).cast("long")
    return (df.filter((F.col(by) >= low) & (F.col(by) <= low + width * bins)).groupBy(b.alias("bin"))
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("se")))


def log_binned(df: DataFrame, by: str, value: str, per_decade: int, least: int = 20) -> DataFrame:
    b = F.floor(F.log10(by) * per_decade).cast("long")
    out = df.filter(F.col(by) > 0).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.25)).alias("q25"), F.percentile(value, F.lit(0.75)).alias("q75"))
    return out.filter(F.col("n") >= least)


def percentile_of(test: DataFrame, train: DataFrame, score: str = "score") -> DataFrame:
    """Each test row with the share of train scores at or below its own: counts of the union by slices, no pair join."""
    both = test.select(score).withColumn("__t", F.lit(0)).unionByName(train.select(score).withColumn("__t", F.lit(1)))
    n = train.filter(F.col(score).isNotNull()).count()
    counts = both.filter(F.col(score).isNotNull()).groupBy(score).agg(F.sum("__t").alias("__k"))
    counts = running(counts, score, ["__k"]).select(score, "__k_run")
    return test.join(counts, score, "left").withColumn("percentile", F.col("__k_run") / F.lit(float(max(n, 1)))).drop("__k_run")


def ks_statistic(df: DataFrame, value: str, label: str, a, b) -> DataFrame:
    """Greatest distance between two empirical distribution functions."""
    c = df.filter(F.col(label).isin(a, b)).groupBy(F.col(value).alias("v")).agg(F.count(F.when(F.col(label) == a, 1)).alias("a"), F.count(F.when(F.col(label) == b, 1)).alias("b"))
    run = running(c, "v", ["a", "b"]).crossJoin(F.broadcast(c.agg(F.sum("a").alias("of_a"), F.sum("b").alias("of_b"))))  # one row
    return run.agg(F.max(F.abs(F.col("a_run") / F.col("of_a") - F.col("b_run") / F.col("of_b"))).alias("ks"))


def nonstationarity(scores: DataFrame, col: str = "score") -> DataFrame:
    """Profile of the scores at each step: mean, median, deviation, IQR, coefficient of variation."""
    q = lambda x: F.percentile(col, F.lit(x))
    return scores.groupBy("end").agg(F.count(col).alias("n"), F.avg(col).alias("mean"), q(0.5).alias("median"), F.stddev_pop(col).alias("sd"), (q(0.75) - q(0.25)).alias("iqr"), F.try_divide(F.stddev_pop(col), F.avg(col)).alias("cv"))


def argmax_steps(scores: DataFrame, col: str = "score") -> DataFrame:
    """How many episodes have their greatest score at each step; the earlier of equal ones."""
    top = scores.groupBy("ep").agg(F.min_by("end", F.struct((-F.col(col)).alias("s"), "end")).alias("end"))
    return top.groupBy("end").agg(F.count("*").alias("n"))


def thresholds(scores: DataFrame, alpha: float, col: str = "score") -> DataFrame:
    """(family, threshold): pooled quantile, mean and greatest of per-step quantiles, mean + k deviations, median + k MAD.

    The k of the last two are those under which a normal score stays with chance 1 - alpha.
    """
    from statistics import NormalDist

    k = NormalDist().inv_cdf(1 - alpha)
    pooled, middle = quantiles(scores, col, [1 - alpha, 0.5])
    steps = scores.groupBy("end").agg(F.percentile(col, F.lit(1 - alpha)).alias("q")).agg(F.avg("q"), F.max("q")).first()
    mean, sd = scores.agg(F.avg(col), F.stddev_pop(col)).first()
    mad = quantiles(scores.select(F.abs(F.col(col) - middle).alias("gap")), "gap", [0.5])[0]
    rows = [("pooled", pooled), ("per_step_mean", steps[0]), ("per_step_max", steps[1]), ("gaussian", mean + k * sd), ("robust", middle + 3 * 1.4826 * mad)]
    return scores.sparkSession.createDataFrame([(n, float(v)) for n, v in rows], "family string, threshold double")


def alarm_rates(scores: DataFrame, episodes: DataFrame, rules: DataFrame, col: str = "score") -> DataFrame:
    """(family, fpr, detection_rate): each threshold of ``rules`` (some rows) on the episodes, failures told before they happen."""
    parts = scores.join(episodes.select("ep", "fail", "n_steps"), "ep").filter(F.col("end") < F.col("fail")).groupBy("ep", "fail", "n_steps").agg(F.max(col).alias("top"))
    fired = (F.col("top") > F.col("threshold")).cast("double")
    return parts.crossJoin(F.broadcast(rules)).groupBy("family").agg(F.avg(F.when(F.col("fail") == F.col("n_steps"), fired)).alias("fpr"), F.avg(F.when(F.col("fail") < F.col("n_steps"), fired)).alias("detection_rate"))


def or_combination(named: dict[str, DataFrame], calibration: dict[str, DataFrame]) -> DataFrame:
    """(ep, end, z): greatest of the detectors' z-scores by scalar calibration moments; null if one is null."""
    out, cols = None, []
    for name, scores in named.items():
        m = calibration[name].agg(F.avg("score").alias("m"), (F.stddev_pop("score") + FLOOR).alias("s"))
        z = scores.crossJoin(F.broadcast(m)).select("ep", "end", ((F.col("score") - F.col("m")) / F.col("s")).alias(f"z_{name}"))
        cols.append(f"z_{name}")
        out = z if out is None else out.join(z, ["ep", "end"])
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    return out.select("ep", "end", F.when(~missing, F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])).alias("z"))


def auroc_at_leads(df: DataFrame, lead: str, label: str = "label", score: str = "score", least: int = 30) -> DataFrame:
    """(lead, n_pos, n_neg, auroc) by lead time; null where fewer than ``least`` positives are left."""
    out = auroc(df, label, score, [lead])
    return out.withColumn("auroc", F.when(F.col("n_pos") >= least, F.col("auroc")))


def tally(df: DataFrame, keys: Sequence[str], method: str, value: str, base: str, margin: float = 0.01) -> DataFrame:
    """(method, win, tie, loss) of each method against ``base`` on the same keys, ties within ``margin``."""
    mine = df.filter(F.col(method) != base)
    theirs = df.filter(F.col(method) == base).select(*keys, F.col(value).alias("__base"))
    gap = F.col(value) - F.col("__base")
    count = lambda c: F.sum(c.cast("long"))
    return mine.join(theirs, list(keys)).groupBy(method).agg(count(gap > margin).alias("win"), count(F.abs(gap) <= margin).alias("tie"), count(gap < -margin).alias("loss"))


def standardized(df: DataFrame, keys: Sequence[str], values: Sequence[str], finite: Column | None = None) -> DataFrame:
    """Mean and deviation of values by keys over finite rows."""
    kept = df if finite is None else df.filter(finite)
    return kept.groupBy(*keys).agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("sd", F.stddev_pop))], F.count("*").alias("n"))
