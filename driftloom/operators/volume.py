"""Volumes of sublevel sets by weighted draws, proposals inside them, and smoothed moments."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bases import ball_moment, gaussian_moment, total_degree
from .pairs import median_distance, squared_distances

Score = Callable[[np.ndarray], np.ndarray]
#: Draws of one seeded chunk: chunks are numbered, so any task can make any of them.
CHUNK = 8192


def proposal_width(centres: np.ndarray, factor: float = 2.0) -> float:
    """Bandwidth of the mixture around the centres: a multiple of the median nearest distance."""
    return factor * median_distance(centres, 1)


def _chunks(spark: SparkSession, n: int) -> DataFrame:
    count = -(-n // CHUNK)
    return spark.range(count).select("id", F.least(F.lit(CHUNK), F.lit(n) - F.col("id") * CHUNK).cast("long").alias("size"))


def importance_volume(spark: SparkSession, score: Score, level: float, low: Sequence[float], high: Sequence[float], centres: np.ndarray, width: float, n: int, floor: float = 0.05, seed: int = 0) -> DataFrame:
    """One row (draws, inside, volume, standard_error) of ``score <= level`` in a box, from draws around the centres mixed with uniform ones.

    A draw in the set counts the inverse of the mixture's density; the uniform part
    bounds it.  Each chunk of draws returns three sums.
    """
    lo, hi = np.asarray(low, float), np.asarray(high, float)
    dim, box = len(lo), float(np.prod(hi - lo))

    def work(batches):
        for pdf in batches:
            rows = []
            for ident, size in zip(pdf["id"], pdf["size"], strict=True):
                rng = np.random.default_rng([seed, int(ident)])
                flat = rng.uniform(size=size) < floor
                near = centres[rng.integers(len(centres), size=size)] + width * rng.normal(size=(size, dim))
                x = np.where(flat[:, None], rng.uniform(lo, hi, (size, dim)), near)
                ok = ((x >= lo) & (x <= hi)).all(1)
                ok[ok] = score(x[ok]) <= level
                x = x[ok]
                mixture = np.exp(-squared_distances(x, centres) / (2 * width**2)).mean(1) / (2 * math.pi * width**2) ** (dim / 2)
                weight = 1 / ((1 - floor) * mixture + floor / box)
                rows.append((len(x), weight.sum(), (weight**2).sum()))
            yield pd.DataFrame(rows, columns=["k", "w", "w2"])

    sums = _chunks(spark, n).mapInPandas(work, "k long, w double, w2 double").agg(F.sum("k").alias("inside"), F.sum("w").alias("w"), F.sum("w2").alias("w2"))
    value = F.col("w") / n
    return sums.select(F.lit(n).cast("long").alias("draws"), "inside", value.alias("volume"), F.sqrt(F.greatest(F.col("w2") / n - value * value, F.lit(0.0)) / n).alias("standard_error"))


def proposals(spark: SparkSession, score: Score, level: float, n: int, *, base: np.ndarray | None = None, spread: float = 0.1, low: Sequence[float] = (), high: Sequence[float] = (), accept: Score | None = None, seed: int = 0) -> DataFrame:
    """(draw, x) of ``n`` draws that lie in the set: perturbed base points, or uniform ones in a box."""
    lo, hi = np.asarray(low, float), np.asarray(high, float)

    def work(batches):
        for pdf in batches:
            for ident, size in zip(pdf["id"], pdf["size"], strict=True):
                rng = np.random.default_rng([seed, int(ident)])
                x = rng.uniform(lo, hi, (size, len(lo))) if base is None else base[rng.integers(len(base), size=size)] + spread * rng.normal(size=(size, base.shape[1]))
                keep = score(x) <= level
                if accept is not None:
                    keep &= accept(x).astype(bool)
                yield pd.DataFrame({"draw": int(ident) * CHUNK + np.flatnonzero(keep), "x": list(x[keep])})

    return _chunks(spark, n).mapInPandas(work, "draw long, x array<double>")


def _blurred(raw: Callable[[tuple[int, ...]], float], alpha: Sequence[int], eps: float, shape: str) -> float:
    """A moment after blurring: the binomial sum of raw moments and those of a centred normal variable or ball."""

    def centred(beta: Sequence[int]) -> float:
        return math.prod(gaussian_moment(b, eps) for b in beta) if shape == "gauss" else ball_moment(beta, eps)

    total = 0.0
    for beta in np.ndindex(*[a + 1 for a in alpha]):
        c = centred(beta)
        if c:
            total += c * math.prod(math.comb(a, b) for a, b in zip(alpha, beta, strict=True)) * raw(tuple(a - b for a, b in zip(alpha, beta, strict=True)))
    return total


def _moment_matrix(raw: Callable[[tuple[int, ...]], float], n_vars: int, degree: int, eps: float, shape: str) -> np.ndarray:
    index = total_degree(n_vars, degree)
    return np.array([[_blurred(raw, [a + b for a, b in zip(x, y, strict=True)], eps, shape) for y in index] for x in index])


def smoothed_moments(points: np.ndarray, degree: int, eps: float, shape: str = "gauss", mean: bool = False) -> np.ndarray:
    """Monomial moment matrix of points blurred by a normal or a ball of radius ``eps``, summed over the points."""
    over = np.mean if mean else np.sum
    return _moment_matrix(lambda a: float(over(np.prod(points ** np.array(a), axis=1))), points.shape[1], degree, eps, shape)


def smoothed_moments_all(df: DataFrame, channels: Sequence[str], degree: int, eps: float, shape: str = "gauss", mean: bool = True) -> np.ndarray:
    """The same over all rows of a table, from its raw moments up to twice the degree: one aggregate, no point on the driver."""
    ok = df.dropna(subset=list(channels))
    wanted = total_degree(len(channels), 2 * degree)
    power = lambda a: math.prod((F.pow(F.col(c), F.lit(k)) for c, k in zip(channels, a, strict=True)), start=F.lit(1.0))
    row = ok.agg(*[(F.avg if mean else F.sum)(power(a)) for a in wanted]).first()
    return _moment_matrix(dict(zip(wanted, map(lambda v: v or 0.0, row), strict=True)).__getitem__, len(channels), degree, eps, shape)


def gaussian_embedding_product(m1: float, m2: float, v1: float, v2: float, gamma: float) -> float:
    """Inner product of the RBF mean embeddings of two normal variables."""
    s = 1 + 2 * gamma * (v1 + v2)
    return math.exp(-gamma * (m1 - m2) ** 2 / s) / math.sqrt(s)


def prefix_embedding(states: DataFrame, a: int, b: int, gamma: float, lengths: Sequence[int]) -> DataFrame:
    """(n, value): mean RBF kernel over the first ``n`` steps of two episodes."""
    x, y = (states.filter((F.col("ep") == e) & (F.col("t") < max(lengths))).select(F.col("t").alias(f"t{k}"), F.col("x").alias(f"x{k}")) for k, e in ((1, a), (2, b)))
    pairs = x.crossJoin(F.broadcast(y)).withColumns({"reach": F.greatest("t1", "t2") + 1, "k": F.exp(-gamma * F.pow(F.col("x1") - F.col("x2"), 2))})  # two episodes
    sums = pairs.groupBy("reach").agg(F.sum("k").alias("s"))
    grid = states.sparkSession.createDataFrame([(int(n),) for n in lengths], "n long")
    return grid.crossJoin(F.broadcast(sums)).filter("reach <= n").groupBy("n").agg((F.sum("s") / (F.col("n") * F.col("n"))).alias("value"))


def linear_residuals(states: DataFrame, inputs: Sequence[str], target: str, fit_on) -> DataFrame:
    """Residual of the least-squares prediction of ``target``: the normal equations are one aggregate."""
    cols = [F.lit(1.0), *[F.col(c) for c in inputs]]
    ok = states.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*inputs, target]))
    k = len(cols)
    row = ok.filter(fit_on).agg(*[F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k)], *[F.sum(c * F.col(target)) for c in cols]).first()
    beta = np.linalg.solve(np.array(row[:k * k]).reshape(k, k), np.array(row[k * k:]))
    fitted = F.lit(0.0)
    for b, c in zip(beta, cols, strict=True):
        fitted = fitted + float(b) * c
    return ok.withColumn("residual", F.col(target) - fitted)
