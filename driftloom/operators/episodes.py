"""Episodes, splits, normalization and other row-level operators.

Column vocabulary: ``ep`` episode, ``t`` step from 0, ``n_steps`` steps of the episode,
``fail`` first failed step (``n_steps`` for survivors), ``x*`` channels, ``split`` part.
A step without data is absent or null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Written


def no_nan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN becomes null: comparisons and aggregates then skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def number_steps(df: DataFrame, ep: str, order: Sequence[str], channels: dict[str, Column]) -> DataFrame:
    """Long states (ep, t, channels) from an event table; ``order`` must be total within an episode."""
    w = Window.partitionBy(ep).orderBy(*order)
    return df.select(F.col(ep).alias("ep"), (F.row_number().over(w) - 1).cast("long").alias("t"), *[c.cast("double").alias(n) for n, c in channels.items()])


def first_failures(states: DataFrame, failed: Column) -> DataFrame:
    """episodes(ep, n_steps, fail): ``fail`` is the first step that fails, ``n_steps`` if none does."""
    return states.groupBy("ep").agg(F.count("*").alias("n_steps"), F.coalesce(F.min(F.when(failed, F.col("t"))), F.count("*")).alias("fail"))


def from_sentinel(episodes: DataFrame, sentinel: int = -1) -> DataFrame:
    """Episodes that mark survivors by ``sentinel`` in the one encoding used here."""
    return episodes.withColumn("fail", F.when(F.col("fail") == sentinel, F.col("n_steps")).otherwise(F.col("fail")))


def survived(episodes: DataFrame) -> DataFrame:
    return episodes.filter(F.col("fail") == F.col("n_steps"))


def failed(episodes: DataFrame) -> DataFrame:
    return episodes.filter(F.col("fail") < F.col("n_steps"))


def prop_failed(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count("*").alias("n"), F.avg((F.col("fail") < F.col("n_steps")).cast("double")).alias("prop_failed"))


def drop_last(states: DataFrame, episodes: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Cuts the last ``horizon`` steps off every episode; ``fail`` is clipped to the rest."""
    left = F.greatest(F.col("n_steps") - horizon, F.lit(0))
    kept = states.join(episodes.select("ep", left.alias("__n")), "ep").filter(F.col("t") < F.col("__n")).drop("__n")
    return kept, episodes.withColumns({"fail": F.greatest(F.lit(0), F.least("fail", left)), "n_steps": left})


def truncate(states: DataFrame, episodes: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Steps ``start`` to ``end`` (exclusive), counted from 0 again."""
    kept = states.filter((F.col("t") >= start) & (F.col("t") < end)).withColumn("t", F.col("t") - start)
    size = F.greatest(F.least(F.col("n_steps"), F.lit(end)) - start, F.lit(0))
    return kept, episodes.withColumns({"fail": F.least(F.greatest(F.col("fail") - start, F.lit(0)), size), "n_steps": size})


def shuffled(key: str, seed: int) -> Column:
    """A reproducible random order, the same in any engine with MD5."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def _position(df: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``__pos`` from 1 in shuffled order, and ``__n``, within ``by``.

    The order is cut into 4096 slices of the hash: their counts and running sum
    give each slice its first position, so no window holds a whole group.
    """
    marked = df.withColumn("__md5", shuffled(key, seed)).withColumn("__slice", F.substring("__md5", 1, 3))
    counts = marked.groupBy(*by, "__slice").agg(F.count("*").alias("__in"))
    before = Window.partitionBy(*by).orderBy("__slice")
    whole = Window.partitionBy(*by)
    counts = counts.withColumns({"__before": F.sum("__in").over(before) - F.col("__in"), "__n": F.sum("__in").over(whole)}).drop("__in")
    inside = Window.partitionBy(*by, "__slice").orderBy("__md5", key)
    return (marked.withColumn("__rn", F.row_number().over(inside)).join(counts, [*by, "__slice"])
            .withColumn("__pos", F.col("__before") + F.col("__rn")).drop("__md5", "__slice", "__rn", "__before"))


def _cut(position: Column, n: Column, sizes: dict[str, float], absolute: bool = False) -> Column:
    """The part whose cumulative size a position falls under; null beyond all."""
    total, out = 0.0, None
    for name, size in sizes.items():
        total += size
        edge = F.lit(total) if absolute else F.floor(F.round(n * total, 9))
        out = F.when(position <= edge, name) if out is None else out.when(position <= edge, name)
    return out


def split_indices(df: DataFrame, sizes: dict[str, float], seed: int, key: str = "ep") -> DataFrame:
    """Disjoint random parts with sizes ``floor`` of the cumulative fractions; rows beyond 1 are dropped."""
    if sum(sizes.values()) > 1 + 1e-9:
        raise ValueError("fractions exceed 1")
    placed = _position(df, key, seed)
    return placed.withColumn("split", _cut(F.col("__pos"), F.col("__n"), sizes)).drop("__pos", "__n").filter("split is not null")


def split_by_counts(df: DataFrame, counts: dict[str, int], seed: int, key: str = "ep") -> DataFrame:
    placed = _position(df, key, seed)
    return placed.withColumn("split", _cut(F.col("__pos"), F.col("__n"), counts, absolute=True)).drop("__pos", "__n").filter("split is not null")


def stratified_split(episodes: DataFrame, sizes: dict[str, float], no_fail: Sequence[str], seed: int) -> DataFrame:
    """Survivors go to every part, failures to the parts outside ``no_fail`` by renormalised fractions."""
    rest = {k: v for k, v in sizes.items() if k not in no_fail}
    scaled = {k: v / sum(rest.values()) for k, v in rest.items()} if rest else {}
    good = split_indices(survived(episodes), sizes, seed)
    return good.unionByName(split_indices(failed(episodes), scaled, seed + 1)) if scaled else good


def subsample(df: DataFrame, n: int, seed: int = 0, key: str = "ep") -> DataFrame:
    """``n`` rows at most, the first in shuffled order: a bounded top-n, not a sort of the table."""
    return df.orderBy(shuffled(key, seed), key).limit(n)


def channel_moments(states: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each channel, nulls skipped, deviation 0 counted as 1."""
    aggs = [F.avg(c).alias(f"mean_{c}") for c in channels] + [F.stddev_pop(c).alias(f"sd_{c}") for c in channels]
    row = states.agg(*aggs)
    return row.withColumns({f"sd_{c}": F.when(F.coalesce(f"sd_{c}", F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"sd_{c}")) for c in channels})


def normalize_channels(states: DataFrame, channels: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Channels as z-scores; the moments are those of the rows where ``fit_on`` holds (all if None)."""
    moments = channel_moments(states if fit_on is None else states.filter(fit_on), channels)
    joined = states.crossJoin(F.broadcast(moments))  # one row
    return joined.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in channels}).select(*states.columns)


def classify(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The first rule that holds."""
    out = None
    for cond, name in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def inside_box(channels: Sequence[str], low: Sequence[float], high: Sequence[float]) -> Column:
    out = F.lit(True)
    for c, a, b in zip(channels, low, high, strict=True):
        out = out & F.col(c).between(a, b)
    return out


def one_state(states: DataFrame, seed: int | None = None, step: int = 0) -> DataFrame:
    """One row an episode: a fixed step, or one drawn by hash."""
    if seed is None:
        return states.filter(F.col("t") == step)
    sizes = states.groupBy("ep").agg(F.count("*").alias("__n"))
    draw = F.conv(F.substring(shuffled("ep", seed), 1, 8), 16, 10).cast("long")
    return states.join(sizes, "ep").filter(F.col("t") == draw % F.col("__n")).drop("__n")


def pick_per_class(df: DataFrame, label: str, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows of each class at most, in shuffled order."""
    best = df.withColumn("__k", F.struct(shuffled(key, seed).alias("h"), F.col(key).alias("k")))
    w = Window.partitionBy(label).orderBy("__k")
    return best.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r", "__k")


# Disturbances: transforms of one channel over the steps of an episode


def _steps() -> Window:
    return Window.partitionBy("ep").orderBy("t")


def degrade(channel: str, efficiency: float) -> Column:
    return F.col(channel) * efficiency


def delay(channel: str, k: int) -> Column:
    """The value ``k`` steps ago, 0 before the start."""
    return F.lag(channel, k, 0.0).over(_steps())


def latency(channel: str, k: int) -> Column:
    """The value ``k`` steps ago, the first value before the start."""
    return F.coalesce(F.lag(channel, k).over(_steps()), F.first(channel).over(_steps().rowsBetween(Window.unboundedPreceding, 0)))


def dropout(channel: str, dropped: Column) -> Column:
    """The last value that was not dropped; 0 before the first."""
    return F.coalesce(F.last(F.when(~dropped, F.col(channel)), ignorenulls=True).over(_steps()), F.lit(0.0))


def periodic(amplitude: float, period: float, phase: float = 0.0) -> Column:
    return F.lit(amplitude) * F.sin(F.lit(2 * 3.141592653589793) * F.col("t") / period + phase)


def impulse(force: float, start: int, length: int) -> Column:
    return F.when(F.col("t").between(start, start + length - 1), force).otherwise(0.0)


def bias(channel: str, offset: float) -> Column:
    return F.col(channel) + offset


def _normal(seed: int) -> Column:
    """A standard normal draw by hash of (ep, t): the same on any executor."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("ep", "t", F.lit(seed), F.lit(k)), 11) + 1) / F.lit(float((1 << 53) + 1))
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))


def noise(channel: str, sd: float, seed: int = 0) -> Column:
    """Sensor or actuator noise."""
    return F.col(channel) + sd * _normal(seed)


def constant_force(force: float) -> Column:
    return F.lit(force)


def wandering_force(states: DataFrame, most: float, smoothness: float = 0.95, seed: int = 0, out: str = "force") -> DataFrame:
    """``states`` with an AR(1) force within ``-most`` and ``most``: smoothness * before + (1 - smoothness) * draw."""
    import numpy as np
    import pandas as pd

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        now, force = 0.0, np.empty(len(pdf))
        for i, z in enumerate(pdf.pop("__z").to_numpy(float)):
            now = smoothness * now + (1 - smoothness) * z * most
            force[i] = min(most, max(-most, now))
        return pdf.assign(**{out: force})

    drawn = states.withColumn("__z", _normal(seed))
    return drawn.groupBy("ep").applyInPandas(work, f"{states.schema.simpleString()[7:-1]},{out} double")


def composite(states: DataFrame, channel: str, transforms: Sequence) -> DataFrame:
    """Disturbances one after another: each is a function of a channel's name to a Column."""
    for change in transforms:
        states = states.withColumn(channel, change(channel))
    return states


def collect_survivors(draw, n: int, rounds: int = 20):
    """Episodes that survive, from ``draw(round)`` until there are ``n``: rejection sampling with an error after ``rounds``.

    Each round is drawn, written and counted once.
    """
    kept, found, tables = None, 0, None
    for i in range(rounds):
        drawn = survived(draw(i))
        tables = tables or Written(drawn.sparkSession, "survivors")
        more = tables.keep(drawn)
        kept, found = more if kept is None else kept.unionByName(more), found + more.count()
        if found >= n:
            return kept.orderBy(shuffled("ep", 0), "ep").limit(n)
    raise ValueError(f"fewer than {n} survivors after {rounds} rounds")


def continue_survivors(episodes: DataFrame, later: DataFrame) -> DataFrame:
    """Survivors with the failure that a longer run (ep, fail, n_steps) has found; failures stay, unknown ones stay censored."""
    more = later.select("ep", F.col("fail").alias("__fail"), F.col("n_steps").alias("__n"))
    joined = episodes.join(more, "ep", "left")
    open_end = F.col("fail") == F.col("n_steps")
    return joined.withColumns({"fail": F.when(open_end, F.coalesce("__fail", "fail")).otherwise(F.col("fail")), "n_steps": F.when(open_end, F.coalesce("__n", "n_steps")).otherwise(F.col("n_steps"))}).drop("__fail", "__n")
