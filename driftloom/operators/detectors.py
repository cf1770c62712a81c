"""One-class detectors: ``fit`` returns an immutable model, ``score`` adds a column.

A higher score is more anomalous.  Small matrices reach the driver (a moment
matrix, a Gram matrix of a capped fit set); scoring never does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bases
from .pairs import Kernel, bandwidth, knn_all, reference


#: Rows that a score is made of at once: features and kernel values of a block are many times its size.
SCORED_ROWS = 256


def _score_blocks(df: DataFrame, vector: str, fn) -> DataFrame:
    """``df`` with ``score = fn(block)``, of ``SCORED_ROWS`` at a time; rows without a vector get null."""
    schema = df.drop("score").schema.simpleString()[7:-1]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = pdf[vector].notna().to_numpy()
            out = np.full(len(pdf), np.nan)
            if ok.any():
                block = np.array([np.ravel(v) for v in pdf.loc[ok, vector]], dtype=float)
                out[ok] = np.concatenate([fn(block[at:at + SCORED_ROWS]) for at in range(0, len(block), SCORED_ROWS)])
            yield pdf.assign(score=pd.Series(out, index=pdf.index).astype(object).where(ok, None))

    return df.drop("score").mapInPandas(work, f"{schema},score double")


#: Polynomial features up to which moments and scores are Column expressions.
COLUMNS = 32


def _as_vector(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """``df`` with ``__x``, the channels as an array; null where one of them is."""
    missing = F.lit(False)
    for c in channels:
        missing = missing | F.col(c).isNull()
    return df.withColumn("__x", F.when(~missing, F.array(*[F.col(c).cast("double") for c in channels])))


@dataclass(frozen=True)
class Gaussian:
    """Distance to the mean in units of each channel's deviation; all in Column expressions."""

    channels: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, channels: Sequence[str], eps: float = 1e-8) -> Gaussian:
        row = df.agg(*[F.avg(c) for c in channels], *[F.stddev_pop(c) for c in channels]).first()
        n = len(channels)
        return Gaussian(tuple(channels), tuple(row[:n]), tuple((s or 0.0) + eps for s in row[n:]))

    def score(self, df: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for c, m, s in zip(self.channels, self.mean, self.sd, strict=True):
            total = total + F.pow((F.col(c) - m) / s, 2)
        return df.withColumn("score", F.sqrt(total))


@dataclass(frozen=True)
class CDPolynomial:
    """Christoffel-Darboux score ``v(x)ᵀ M⁻¹ v(x)`` with the empirical moment matrix M."""

    channels: tuple[str, ...]
    degree: int
    basis: str
    inverse: np.ndarray
    mean_score: float
    factor: np.ndarray | None = None  # triangle R with RᵀR = M, of the qr method

    @staticmethod
    def moments(df: DataFrame, channels: Sequence[str], degree: int, basis: str = "monomial") -> np.ndarray:
        """M as one aggregate: a sum per pair of features, or block products where there are over ``COLUMNS`` of them."""
        cols = list(bases.features(channels, degree, basis).values())
        s = len(cols)
        if s > COLUMNS:
            from .reduction import map_vectors, second_moment

            phi = map_vectors(_as_vector(df, channels).select("__x").filter("__x is not null"), "__x", lambda x: bases.features_np(x, degree, basis), "phi")
            n, _, g = second_moment(phi, "phi")
            return g / n
        ok = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in channels))
        row = ok.agg(*[F.avg(cols[i] * cols[j]) for i in range(s) for j in range(i, s)]).first()
        m, it = np.zeros((s, s)), iter(row)
        for i in range(s):
            for j in range(i, s):
                m[i, j] = m[j, i] = next(it)
        return m

    @staticmethod
    def fit(df: DataFrame, channels: Sequence[str], degree: int, basis: str = "monomial", eps: float = 0.0, method: str = "chol") -> CDPolynomial:
        """``method``: chol, solve or lstsq on the moment matrix, or qr of the features themselves (without ``eps``), which
        squares no condition number: M is never formed."""
        if method == "qr":
            from .factorizations import tall_qr

            n, r = tall_qr(_as_vector(df, channels), "__x", lambda x: bases.features_np(x, degree, basis))
            r = r / np.sqrt(n)
            half = np.linalg.pinv(r)
            return CDPolynomial(tuple(channels), degree, basis, half @ half.T, float(len(r)), r)
        m = CDPolynomial.moments(df, channels, degree, basis)
        a = m + eps * np.eye(len(m))
        if method == "chol":
            half = np.linalg.inv(np.linalg.cholesky(a))
            inverse = half.T @ half
        else:
            inverse = np.linalg.solve(a, np.eye(len(a))) if method == "solve" else np.linalg.pinv(a)
        return CDPolynomial(tuple(channels), degree, basis, inverse, float(np.trace(inverse @ m)))

    def score(self, df: DataFrame) -> DataFrame:
        """Column expressions up to ``COLUMNS`` features; block products beyond, and triangular solves after qr."""
        cols = list(bases.features(self.channels, self.degree, self.basis).values())
        if self.factor is not None or len(cols) > COLUMNS:
            return _score_blocks(_as_vector(df, self.channels), "__x", self._values).drop("__x")
        total = F.lit(0.0)
        for i, a in enumerate(cols):
            total = total + float(self.inverse[i, i]) * a * a
            for j in range(i + 1, len(cols)):
                total = total + 2 * float(self.inverse[i, j]) * a * cols[j]
        return df.withColumn("score", total)

    def _values(self, x: np.ndarray) -> np.ndarray:
        v = bases.features_np(x, self.degree, self.basis)
        if self.factor is None:
            return np.einsum("ij,jk,ik->i", v, self.inverse, v)
        return (np.linalg.solve(self.factor.T, v.T) ** 2).sum(0)

    def christoffel(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("score", 1 / F.col("score"))

    def value_and_gradient(self, x: np.ndarray, h: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
        f = lambda p: np.einsum("ij,jk,ik->i", v := bases.features_np(p, self.degree, self.basis), self.inverse, v)
        grad = np.column_stack([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(x.shape[1])])
        return f(x), grad

    def nearest_inside(self, df: DataFrame, vector: str, level: float, steps: int = 60) -> DataFrame:
        """Points moved to the sublevel set by projection on successive half-spaces of the linearized score."""

        def fn(block: np.ndarray) -> np.ndarray:
            x = block.copy()
            for _ in range(steps):
                v, g = self.value_and_gradient(x)
                over = np.maximum(v - level, 0) / np.maximum((g * g).sum(1), 1e-12)
                x = x - over[:, None] * g
            return np.linalg.norm(x - block, axis=1)

        return _score_blocks(df, vector, fn).withColumnRenamed("score", "distance")


@dataclass(frozen=True)
class KNN:
    """Mean distance to the ``k`` nearest of all fitted rows, met in blocks."""

    key: str
    vector: str
    k: int
    fitted: DataFrame

    @staticmethod
    def fit(df: DataFrame, vector: str, key: str, k: int = 5) -> KNN:
        return KNN(key, vector, k, df.select(key, vector))

    def score(self, df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """(key, carry, score, kth, nearest); a fitted row is among its own neighbours."""
        near = knn_all(df, self.fitted, self.vector, self.key, self.k)
        return df.select(self.key, *carry).join(near, self.key).select(self.key, *carry, "score", "kth", "nearest") if carry else near


def pivoted_cholesky(kernel: Kernel, x: np.ndarray, rank: int, eps: float = 0.0, pivot: str = "rp", seed: int = 0) -> tuple[np.ndarray, list[int]]:
    """(F, pivots) with ``K ≈ F Fᵀ``: greedy, random (by residual) or uniform pivots.

    Exhausted pivots are skipped; it ends at the rank, or once the greatest residual
    is at most ``eps`` or a 10⁻¹⁰ part of the greatest diagonal.
    """
    rng, n = np.random.default_rng(seed), len(x)
    d = kernel.diag(x).astype(float)
    floor = max(eps, 1e-10 * d.max()) if n else 0.0
    f, pivots, order = np.zeros((n, 0)), [], rng.permutation(n)
    it = iter(order)
    while len(pivots) < min(rank, n) and d.max() > floor:
        if pivot == "greedy":
            i = int(d.argmax())
        elif pivot == "rp":
            p = np.where(d > floor, d, 0)
            i = int(rng.choice(n, p=p / p.sum()))
        else:
            i = next((j for j in it if d[j] > floor), -1)
            if i < 0:
                break
        col = kernel(x, x[i:i + 1])[:, 0] - f @ f[i]
        col = col / np.sqrt(d[i])
        f = np.column_stack((f, col))
        d = np.maximum(d - col * col, 0)
        d[i] = 0
        pivots.append(i)
    return f, pivots


def adaptive_ridge(gram: np.ndarray, target: float = 1e3) -> float:
    """The ridge that brings the condition number of ``K + lam n I`` to ``target``."""
    w = np.linalg.eigvalsh(gram)
    top, low = float(w[-1]), float(max(w[0], 0.0))
    return max((top - target * low) / ((target - 1) * len(gram)), 1e-14)


def decade_ridge(gram: np.ndarray, target: float = 1e3) -> float:
    """The least decade from 1e-14 to 1e-1 that brings the condition number of ``K + lam n I`` below ``target``; 1e-3 if none."""
    n, w = len(gram), np.linalg.eigvalsh(gram)
    for e in range(-14, 0):
        low, top = w[0] + 10.0**e * n, w[-1] + 10.0**e * n
        if low > 0 and top / low < target:
            return 10.0**e
    return 1e-3


@dataclass(frozen=True)
class KernCD:
    """Kernel Christoffel score ``k(x,x) - kₓᵀ (K + lam m I)⁻¹ kₓ`` on a capped fit set."""

    kernel: Kernel
    lam: float
    points: np.ndarray
    half: np.ndarray  # inverse Cholesky factor of K + lam m I, exact path
    pivots: tuple[int, ...] = ()
    pinned: np.ndarray | None = None  # inverse factor of K_pp, low-rank path
    middle: np.ndarray | None = None

    @staticmethod
    def fit_points(x: np.ndarray, kernel: Kernel, lam: float | str = 1e-7, rank: int | None = None, pivot: str = "rp", seed: int = 0) -> KernCD:
        m = len(x)
        if rank is None:
            gram = kernel(x, x)
            value = adaptive_ridge(gram) if lam == "condition" else decade_ridge(gram) if lam == "adaptive" else float(lam)
            return KernCD(kernel, value, x, np.linalg.inv(np.linalg.cholesky(gram + value * m * np.eye(m))))
        f, pivots = pivoted_cholesky(kernel, x, rank, pivot=pivot, seed=seed)
        p = x[pivots]
        # features φ(y) = L_pp⁻¹ k_p(y); the ridge is per fit row, so full rank gives the exact score
        pinned = np.linalg.inv(np.linalg.cholesky(kernel(p, p) + 1e-12 * np.eye(len(p)) * kernel.diag(p).max()))
        middle = np.linalg.inv(np.eye(len(p)) * float(lam) * m + f.T @ f)
        return KernCD(kernel, float(lam), p, np.zeros((0, 0)), tuple(pivots), pinned, middle * float(lam) * m)

    @staticmethod
    def fit(df: DataFrame, vector: str, key: str, kernel: Kernel | str = "rbf", heuristic: str = "median", lam: float | str = 1e-7, n: int = 1000, **kw) -> KernCD:
        _, x = reference(df, vector, key, n)
        k = kernel if isinstance(kernel, Kernel) else Kernel(kernel, gamma=bandwidth(x, kernel, heuristic))
        return KernCD.fit_points(x, k, lam, **kw)

    @staticmethod
    def fit_all(df: DataFrame, vector: str, key: str, kernel: Kernel, rank: int, lam: float = 1e-7, pivot: str = "greedy", seed: int = 0, batch: int = 32) -> KernCD:
        """The low-rank fit with every row as a candidate and as a fit row; only pivots and rank x rank sums reach the driver."""
        from ..scratch import Written
        from .factorizations import pivoted_cholesky_all
        from .reduction import second_moment

        tables = Written(df.sparkSession, "kerncd")
        got = pivoted_cholesky_all(df, vector, key, kernel, rank, pivot=pivot, seed=seed, batch=batch, tables=tables)
        n, _, g = second_moment(got.table, "f")
        tables.clear()
        middle = np.linalg.inv(np.eye(len(g)) * lam * n + g)
        return KernCD(kernel, lam, got.points, np.zeros((0, 0)), tuple(got.keys), np.linalg.inv(got.triangle), middle * lam * n)

    def score_points(self, y: np.ndarray) -> np.ndarray:
        k, d = self.kernel(y, self.points), self.kernel.diag(y)
        if self.pinned is None:
            return d - ((k @ self.half.T) ** 2).sum(1)
        phi = k @ self.pinned.T
        return d - (phi * phi).sum(1) + np.einsum("ij,jk,ik->i", phi, self.middle, phi)

    def score(self, df: DataFrame, vector: str) -> DataFrame:
        return _score_blocks(df, vector, self.score_points)

    def update(self, x_new: np.ndarray, exact: bool = False) -> KernCD:
        """One point more: a refit, or the border of the factor with the old ridge on the old rows."""
        points = np.vstack((self.points, x_new.reshape(1, -1)))
        if exact:
            return KernCD.fit_points(points, self.kernel, self.lam)
        m = len(self.points)
        k = self.kernel(self.points, points[-1:])[:, 0]
        c = self.half @ k
        s = np.sqrt(max(self.kernel.diag(points[-1:])[0] + self.lam * (m + 1) - c @ c, 1e-12))
        half = np.zeros((m + 1, m + 1))
        half[:m, :m], half[m, :m], half[m, m] = self.half, -(c @ self.half) / s, 1 / s
        return replace(self, points=points, half=half)

    def batch_update(self, xs: np.ndarray, exact: bool = False) -> KernCD:
        out = self
        for x in xs:
            out = out.update(x, exact)
        return out


@dataclass(frozen=True)
class LinearReconstruction:
    """Reconstruction error of the leading principal directions; stands in for an autoencoder."""

    mean: np.ndarray
    directions: np.ndarray

    @staticmethod
    def fit(df: DataFrame, vector: str, rank: int) -> LinearReconstruction:
        """From the second moment of all rows."""
        from .reduction import PCA

        model = PCA.fit(df, vector, rank)
        return LinearReconstruction(model.mean, model.directions)

    def score(self, df: DataFrame, vector: str) -> DataFrame:
        def fn(block: np.ndarray) -> np.ndarray:
            c = block - self.mean
            return ((c - c @ self.directions.T @ self.directions) ** 2).mean(1)

        return _score_blocks(df, vector, fn)


@dataclass(frozen=True)
class RudiSupport:
    """Support estimate on greedy pivots: residual of the pivots' span plus filtered covariance."""

    kernel: Kernel
    points: np.ndarray
    root: np.ndarray
    mean: np.ndarray
    filtered: np.ndarray

    @staticmethod
    def fit_points(x: np.ndarray, kernel: Kernel, rank: int, lam: float = 1e-3, hard: bool = False) -> RudiSupport:
        _, pivots = pivoted_cholesky(kernel, x, rank, pivot="greedy")
        p = x[pivots]
        w, v = np.linalg.eigh(kernel(p, p))
        root = v / np.sqrt(np.maximum(w, 1e-12)) @ v.T
        phi = kernel(x, p) @ root
        mean = phi.mean(0)
        cw, cv = np.linalg.eigh(np.cov(phi.T, bias=True).reshape(len(p), len(p)))
        keep = (cw > lam).astype(float) if hard else cw / (cw + lam)
        return RudiSupport(kernel, p, root, mean, (cv * (1 - keep)) @ cv.T)

    def score_points(self, y: np.ndarray) -> np.ndarray:
        phi = self.kernel(y, self.points) @ self.root
        rest = self.kernel.diag(y) - (phi * phi).sum(1)
        c = phi - self.mean
        return rest + np.einsum("ij,jk,ik->i", c, self.filtered, c)


def loo_objective(gram: np.ndarray, lam: float) -> tuple[float, float]:
    """(mean leave-one-out score, log determinant) of ``K + lam I`` from one inverse."""
    a = gram + lam * np.eye(len(gram))
    inv = np.linalg.inv(a)
    return float(np.mean(1 / np.diag(inv) - lam)), float(np.linalg.slogdet(a)[1])


#: Detector factories by name.
METHODS = {"gaussian": Gaussian.fit, "cd": CDPolynomial.fit, "knn": KNN.fit, "kerncd": KernCD.fit, "linear_ae": LinearReconstruction.fit}
