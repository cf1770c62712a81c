"""Whole experiments: split, normalize, window, fit, score, calibrate, measure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import metrics as M
from ..operators import sequences as Q
from ..operators import windows as W
from ..scratch import Written

SIZES = {"train": 0.4, "norm": 0.2, "cal": 0.2, "test": 0.2}


@dataclass(frozen=True)
class Result:
    metrics: DataFrame
    scores: DataFrame
    threshold: float


def run_experiment(states: DataFrame, episodes: DataFrame, channels: str | Sequence[str] = "x", *, method: Q.Fit | str = "gaussian", width: int = 5, stride: int = 1, horizon: int = 0, survival_only: bool = True, alpha: float = 0.1, seed: int = 0, sizes: dict[str, float] = SIZES) -> Result:
    """The one-class experiment with any method on windows.

    Norm and cal hold survivors only; train does with ``survival_only``, else it has
    failures too, up to ``horizon`` steps before they happen.  Windows and scores are
    kept for the run, so moments, threshold and metrics don't make them again.
    """
    channels = [channels] if isinstance(channels, str) else list(channels)
    fit = Q.METHODS[method](width) if isinstance(method, str) else method
    no_fail = ("train", "norm", "cal") if survival_only else ("norm", "cal")
    split = E.stratified_split(episodes, sizes, no_fail, seed)
    parted = states.join(split.select("ep", "split"), "ep")
    scaled = E.normalize_channels(parted, channels, F.col("split") == "train")
    wide = Q.as_sequence(W.sliding(scaled, channels, width, stride)).join(split, "ep")
    tables = Written(states.sparkSession, "experiment")
    wide = tables.keep(wide.select(F.concat_ws("/", "ep", "end").alias("key"), "ep", "end", "split", "fail", "n_steps", "w"))
    score = fit(wide.filter((F.col("split") == "train") & Q.in_training(horizon)))
    scored = tables.keep(Q.scored(wide.filter((F.col("split") != "train") & (F.col("end") <= F.col("fail"))), score).select("ep", "end", "split", "score"))
    moments = M.znorm_by_end(scored.filter("split = 'norm'"))
    z = M.apply_znorm(scored, moments)
    threshold = M.max_conformal_threshold(z.filter("split = 'cal'"), alpha)
    test = z.filter("split = 'test'").drop("split")
    tables.clear(last=1)
    return Result(M.detection_metrics(test, episodes, threshold), test, threshold)


def run_survival(states: DataFrame, episodes: DataFrame, channels: Sequence[str], *, method: Q.Fit | str = "gaussian", horizon: int = 5, alpha: float = 0.1, seed: int = 0, sizes: dict[str, float] = SIZES) -> Result:
    """The survival benchmark: single states under any method, no z-norm per step, failures scored past their failure."""
    fit = Q.METHODS[method](1) if isinstance(method, str) else method
    split = E.stratified_split(episodes, sizes, ("train", "norm", "cal"), seed)
    vector = lambda df: df.select(F.concat_ws("/", "ep", "t").alias("key"), "ep", F.col("t").alias("end"), *[c for c in df.columns if c == "split"], F.array(*channels).alias("w"))
    cut, _ = E.drop_last(states, episodes, horizon)
    parted = Written(states.sparkSession, "survival").keep(vector(cut.join(split.select("ep", "split"), "ep")))
    score = fit(parted.filter("split = 'train'"))
    run = lambda df: Q.scored(df, score).select("ep", "end", "score")
    threshold = M.max_conformal_threshold(run(parted.filter("split = 'cal'")), alpha, "score")
    test_eps = split.filter("split = 'test'")
    survivors = run(parted.join(E.survived(test_eps).select("ep"), "ep", "left_semi"))
    fpr = survivors.groupBy("ep").agg(F.max((F.col("score") > threshold).cast("double")).alias("f")).agg(F.avg("f").alias("fpr"))
    broken = run(vector(states.join(E.failed(test_eps).select("ep"), "ep", "left_semi")))
    leads = M.first_alarms(broken, episodes, threshold, "score").select("ep", F.col("signed_lead").alias("lead"))
    return Result(M.edr_and_lead(leads).crossJoin(F.broadcast(fpr)), survivors.unionByName(broken), threshold)
