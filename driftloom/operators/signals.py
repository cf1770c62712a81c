"""Frequency and autocorrelation features of a channel, per episode.

Transforms take a row that holds the values of one episode or window; everything
after them is Column expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TAU = 2 * math.pi


def windows(states: DataFrame, n: int) -> DataFrame:
    """Every run of ``n`` steps as an episode of its own, ``ep * 100000 + number of the run``; the last may be shorter."""
    return states.withColumns({"ep": (F.col("ep") * 100000 + F.floor(F.col("t") / n)).cast("long"), "t": F.col("t") % n})


def spectrum(states: DataFrame, channel: str, n: int) -> DataFrame:
    """(ep, k, re, im, mag) for k = 0 .. n // 2 over the first ``n`` steps; shorter episodes are left out.

    A transform needs all ``n`` values at once: they meet in one row, batches of rows
    go through one call.
    """
    part = states.filter((F.col("t") < n) & F.col(channel).isNotNull())
    rows = part.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("t", F.col(channel).cast("double").alias("v"))))["v"].alias("v")).filter(F.size("v") == n)
    kind = dict(states.dtypes)["ep"]

    def work(batches):
        for pdf in batches:
            if len(pdf):
                f = np.fft.rfft(np.stack(pdf["v"].to_numpy()), axis=1)
                yield pd.DataFrame({"ep": pdf["ep"], "re": list(f.real), "im": list(f.imag)})

    wide = rows.mapInPandas(work, f"ep {kind}, re array<double>, im array<double>")
    out = wide.select("ep", "im", F.posexplode("re").alias("k", "re")).select("ep", F.col("k").cast("long").alias("k"), "re", F.col("im")[F.col("k")].alias("im"))
    return out.withColumn("mag", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def dominant_frequency(states: DataFrame, channel: str, n: int, fs: float = 1.0) -> DataFrame:
    """(ep, freq): frequency of greatest magnitude without the mean; the lower of equal ones."""
    s = spectrum(states, channel, n).filter("k > 0")
    return s.groupBy("ep").agg((F.max_by("k", F.struct(F.round("mag", 9), -F.col("k"))) * F.lit(fs / n)).alias("freq"))


def spectral_entropy(states: DataFrame, channel: str, n: int, eps: float = 1e-12) -> DataFrame:
    """(ep, entropy): entropy of the power spectrum over the log of the bins."""
    bins = n // 2 + 1
    power = spectrum(states, channel, n).withColumn("p", F.col("mag") * F.col("mag"))
    share = power.withColumn("p", F.col("p") / (F.sum("p").over(Window.partitionBy("ep")) + eps))
    return share.groupBy("ep").agg((-F.sum(F.col("p") * F.log(F.col("p") + eps)) / math.log(bins)).alias("entropy"))


def reconstruction(states: DataFrame, channel: str, n: int, harmonics: int) -> DataFrame:
    """(ep, t, y): the channel from its first ``harmonics`` frequencies and the mean."""
    kept = spectrum(states, channel, n).filter(F.col("k") <= harmonics)
    grid = kept.select("ep", "k", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))
    angle = F.lit(TAU / n) * (F.col("k") * F.col("t") % n)
    twice = F.when((F.col("k") == 0) | (2 * F.col("k") == n), 1.0).otherwise(2.0)
    return grid.groupBy("ep", F.col("t").cast("long").alias("t")).agg((F.sum(twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))) / n).alias("y"))


def autocorrelation(states: DataFrame, channel: str, n: int, max_lag: int) -> DataFrame:
    """(ep, lag, acf) of the first ``n`` steps about their mean, over the variance; null for a flat channel."""
    part = states.filter(F.col("t") < n).select("ep", "t", F.col(channel).alias("v"))
    part = part.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("ep")))
    # the values that a lag pairs come from one framed list, no self-join
    ahead = F.collect_list("v").over(Window.partitionBy("ep").orderBy("t").rowsBetween(0, max_lag))
    rows = part.withColumn("a", ahead).select("ep", "v", F.posexplode("a").alias("lag", "u"))
    sums = rows.groupBy("ep", F.col("lag").cast("long").alias("lag")).agg(F.sum(F.col("v") * F.col("u")).alias("s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy("ep"))
    return sums.select("ep", "lag", F.when(zero > 1e-12, F.col("s") / zero).alias("acf"))


def acf_period(states: DataFrame, channel: str, n: int, max_lag: int, min_lag: int = 2) -> DataFrame:
    """(ep, period): first local maximum of the autocorrelation from ``min_lag`` on; ``n`` if there is none."""
    a = autocorrelation(states, channel, n, max_lag).withColumn("acf", F.round("acf", 9))
    w = Window.partitionBy("ep").orderBy("lag")
    peak = (F.col("lag") >= min_lag) & (F.col("acf") > F.lag("acf").over(w)) & (F.col("acf") >= F.lead("acf").over(w))
    return a.withColumn("peak", peak).groupBy("ep").agg(F.coalesce(F.min(F.when(F.col("peak"), F.col("lag"))), F.lit(n)).cast("long").alias("period"))


def acf_window(states: DataFrame, channel: str, n: int, max_lag: int, least: int = 2) -> DataFrame:
    """(ep, width): first lag at which the autocorrelation is no longer positive, ``least`` at least; ``n`` if none."""
    a = autocorrelation(states, channel, n, max_lag)
    return a.groupBy("ep").agg(F.greatest(F.coalesce(F.min(F.when(F.round("acf", 9) <= 0, F.col("lag"))), F.lit(n)), F.lit(least)).cast("long").alias("width"))


def window_from_peak(states: DataFrame, channel: str, n: int, periods: float = 1.0, method: str = "median") -> DataFrame:
    """One row: a window width of ``periods`` of the typical dominant frequency."""
    f = dominant_frequency(states, channel, n)
    typical = F.percentile("freq", F.lit(0.5)) if method == "median" else F.avg("freq")
    return f.agg(F.least(F.lit(n), F.greatest(F.lit(1), F.bround(periods / typical))).cast("long").alias("width"))
