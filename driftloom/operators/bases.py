"""Polynomial and temporal bases.

Polynomial features are generated as Column expressions, so they stay inside
whole-stage code generation; temporal bases are small matrices built on the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_degree(n_vars: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of total degree up to ``degree``, by degree and then lexicographically descending."""
    out = []
    for d in range(degree + 1):
        picks = itertools.combinations_with_replacement(range(n_vars), d)
        out += [tuple(p.count(v) for v in range(n_vars)) for p in picks]
    return out


def ladder(x: Column, degree: int, basis: str) -> list[Column]:
    """Values of the univariate polynomials 0 .. degree: monomial, chebyshev or hermite (probabilists')."""
    out = [F.lit(1.0), x]
    for k in range(2, degree + 1):
        if basis == "monomial":
            out.append(out[-1] * x)
        elif basis == "chebyshev":
            out.append(2 * x * out[-1] - out[-2])
        elif basis == "hermite":
            out.append(x * out[-1] - (k - 1) * out[-2])
        elif basis == "legendre":
            out.append(((2 * k - 1) * x * out[-1] - (k - 1) * out[-2]) / k)
        else:
            raise ValueError(f"unknown basis {basis}")
    return out[:degree + 1]


def features(channels: Sequence[str], degree: int, basis: str = "monomial", intercept: bool = True, domain: Sequence[tuple[float, float]] | None = None) -> dict[str, Column]:
    """Named products of univariate polynomials; ``domain`` maps each channel to [-1, 1] first."""
    cols = [F.col(c) for c in channels]
    if domain is not None:
        cols = [(2 * c - a - b) / (b - a) for c, (a, b) in zip(cols, domain, strict=True)]
    ladders = [ladder(c, degree, basis) for c in cols]
    out = {}
    for alpha in total_degree(len(channels), degree):
        if not intercept and not any(alpha):
            continue
        value = F.lit(1.0)
        for lad, k in zip(ladders, alpha, strict=True):
            if k:
                value = value * lad[k]
        out["phi_" + "_".join(map(str, alpha))] = value
    return out


def transform(states: DataFrame, channels: Sequence[str], degree: int, basis: str = "monomial", **kw) -> DataFrame:
    return states.withColumns(features(channels, degree, basis, **kw))


def ladder_np(x: np.ndarray, degree: int, basis: str) -> np.ndarray:
    """The same ladder for arrays: shape (degree + 1, len(x))."""
    out = [np.ones_like(x), x]
    for k in range(2, degree + 1):
        if basis == "monomial":
            out.append(out[-1] * x)
        elif basis == "chebyshev":
            out.append(2 * x * out[-1] - out[-2])
        elif basis == "hermite":
            out.append(x * out[-1] - (k - 1) * out[-2])
        else:
            out.append(((2 * k - 1) * x * out[-1] - (k - 1) * out[-2]) / k)
    return np.array(out[:degree + 1])


def features_np(x: np.ndarray, degree: int, basis: str = "monomial") -> np.ndarray:
    ladders = [ladder_np(x[:, j], degree, basis) for j in range(x.shape[1])]
    return np.column_stack([np.prod([ladders[j][k] for j, k in enumerate(a)], axis=0) for a in total_degree(x.shape[1], degree)])


# Temporal bases on the grid 0 .. 1


def temporal_matrix(kind: str, n_steps: int, n_funcs: int, **kw) -> np.ndarray:
    """Values (n_steps, n_funcs) of gaussian, vonmises, sine, fourier or bspline functions."""
    t = np.linspace(0, 1, n_steps)
    if kind == "gaussian":
        centres, width = np.linspace(0, 1, n_funcs), kw.get("width", 1 / n_funcs)
        return np.exp(-0.5 * ((t[:, None] - centres) / width) ** 2)
    if kind == "vonmises":
        centres, kappa = np.linspace(0, 1, n_funcs, endpoint=False), kw.get("kappa", 10.0)
        return np.exp(kappa * (np.cos(2 * np.pi * (t[:, None] - centres)) - 1))
    if kind == "sine":
        return np.sin(np.pi * t[:, None] * np.arange(1, n_funcs + 1))
    if kind == "fourier":
        cols = [np.ones(n_steps)]
        for k in range(1, n_funcs // 2 + 1):
            cols += [np.sin(2 * np.pi * k * t), np.cos(2 * np.pi * k * t)]
        return np.column_stack(cols[:n_funcs])
    if kind == "bspline":
        p = kw.get("degree", 3)
        inner = np.linspace(0, 1, n_funcs - p + 1)
        knots = np.concatenate((np.zeros(p), inner, np.ones(p)))
        x = np.minimum(t, 1 - 1e-12)
        b = ((knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])).astype(float)
        for d in range(1, p + 1):
            n = len(knots) - d - 1
            left, right = knots[d:d + n] - knots[:n], knots[d + 1:d + 1 + n] - knots[1:1 + n]
            with np.errstate(divide="ignore", invalid="ignore"):
                wl = np.where(left > 0, (x[:, None] - knots[:n]) / left, 0)
                wr = np.where(right > 0, (knots[d + 1:d + 1 + n] - x[:, None]) / right, 0)
            b = wl * b[:, :n] + wr * b[:, 1:n + 1]
        return b
    raise ValueError(f"unknown temporal basis {kind}")


def encoder(b: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """``(BᵀB + ridge I)⁻¹ Bᵀ``: coefficients of a trajectory on the basis."""
    return np.linalg.solve(b.T @ b + ridge * np.eye(b.shape[1]), b.T)


def coefficients(states: DataFrame, channel: str, h: np.ndarray) -> DataFrame:
    """(ep, k, coef): coefficients of each episode's channel, as a join with the small matrix ``h`` and a sum."""
    spark = states.sparkSession
    rows = [(int(k), int(t), float(h[k, t])) for k in range(h.shape[0]) for t in range(h.shape[1])]
    table = spark.createDataFrame(rows, "k long, t long, h double")  # a basis: funcs x steps
    return states.join(F.broadcast(table), "t").groupBy("ep", "k").agg(F.sum(F.col("h") * F.col(channel)).alias("coef"))


def chebyshev_nodes(n: int, low: float = -1.0, high: float = 1.0) -> np.ndarray:
    return (low + high) / 2 + (high - low) / 2 * np.cos(np.pi * np.arange(n + 1) / n)


def chebyshev_from_nodes(values: np.ndarray) -> np.ndarray:
    """Coefficients from values at the extrema nodes (type I cosine sum)."""
    n = len(values) - 1
    k = np.arange(n + 1)
    weight = np.ones(n + 1)
    weight[[0, -1]] = 0.5
    c = 2 / n * (np.cos(np.pi * np.outer(k, k) / n) @ (weight * values))
    c[[0, -1]] /= 2
    return c


def gaussian_moment(k: int, sigma: float) -> float:
    """k-th moment of a centred normal variable."""
    return 0.0 if k % 2 else sigma**k * math.prod(range(1, k, 2))


def ball_moment(alpha: Sequence[int], radius: float = 1.0) -> float:
    """Mean of a monomial over the uniform distribution on a centred ball."""
    if any(a % 2 for a in alpha):
        return 0.0
    d, k = len(alpha), sum(alpha)
    sphere = math.prod(math.gamma((a + 1) / 2) for a in alpha) / math.gamma((d + k) / 2)
    unit = math.pi ** (d / 2) / math.gamma(d / 2)
    return radius**k * sphere / unit * d / (d + k)


def cd_uniform(x: Column, degree: int) -> Column:
    """Christoffel-Darboux polynomial of the uniform measure on [-1, 1]: sum of (2k + 1) P_k²."""
    total = F.lit(0.0)
    for k, p in enumerate(ladder(x, degree, "legendre")):
        total = total + (2 * k + 1) * p * p
    return total


def cd_arcsine(x: Column, degree: int) -> Column:
    """The same of the arcsine measure: 1 + 2 sum T_k²."""
    total = F.lit(1.0)
    for p in ladder(x, degree, "chebyshev")[1:]:
        total = total + 2 * p * p
    return total
