"""Detectors on windows: adapters between window tables and detectors, and the registry of methods.

A window table has ``key`` (unique), and ``w``: flat windows, time by time.  A method
is ``fit(windows) -> score`` where ``score`` maps a block of flat windows to scores;
``scored`` applies it batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Written
from . import bases
from .detectors import KernCD, _score_blocks
from .matching import nearest_in_cells
from .pairs import Kernel, bandwidth, knn_all, median_distance, median_of_pairs, reference
from .reduction import map_vectors, median_gap, outer_sums, second_moment, sequence_features, sequence_gram, sequence_own, waves
from .trajectory_kernels import Scattering, convolution_counts

Score = Callable[[np.ndarray], np.ndarray]
Fit = Callable[[DataFrame], Score]
#: Windows that a kernel method is fitted on, at most: the default of ``subsample``.
FIT_WINDOWS = 1000
#: Distinct numbers of a step that the driver holds, at most, for the median of their distances.
HELD_VALUES = 1 << 22
#: Features of a sequence kernel, at most; mean square up to which a direction of features tells nothing beside a ridge of
#: 1e-7; square of the range in units of 1 / gamma up to which the static kernel is laid out in waves.
SEQUENCE_FEATURES, FAINT, MOST_WAVES = 4096, 1e-14, 1e5
#: Values of a window up to which cells in space tell near ones from far ones.
FEW_DIMENSIONS = 8


def as_sequence(windows: DataFrame, vector: str = "w") -> DataFrame:
    """Windows of several channels (array of steps) as flat vectors; windows of one channel are flat already."""
    nested = dict(windows.dtypes)[vector].startswith("array<array<")
    return windows.withColumn(vector, F.flatten(vector)) if nested else windows


def with_seq_len(fn: Callable[[np.ndarray], np.ndarray], width: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function of (n, width, channels) as one of flat windows."""
    return lambda x: fn(x.reshape(len(x), width, -1))


def subsample(fit_points: Callable[[np.ndarray], Score], n: int = FIT_WINDOWS, seed: int = 0) -> Fit:
    """A fit on arrays as a fit on a table, over at most ``n`` of its windows in shuffled order."""
    return lambda windows: fit_points(reference(windows, "w", "key", n, seed)[1])


def dealt(windows: DataFrame) -> DataFrame:
    """The same over all tasks: a window takes far longer than its few bytes tell, so a table of few files would make few tasks."""
    spark = windows.sparkSession
    return windows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "key")


def scored(windows: DataFrame, score: Score | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``windows`` with ``score``."""
    return score.table(windows) if isinstance(score, Neighbours) else _score_blocks(dealt(windows), "w", score)


@dataclass(frozen=True)
class Neighbours:
    """Mean distance to the k nearest of all fitted windows: searched in cells where windows are short, else met in blocks."""

    fitted: DataFrame
    k: int

    def table(self, windows: DataFrame) -> DataFrame:
        fitted = self.fitted.select(F.col("key").alias("key"), F.col("w").alias("w"))
        first = fitted.select(F.size("w")).first()
        near = (nearest_in_cells if first and first[0] <= FEW_DIMENSIONS else knn_all)(windows, fitted, "w", "key", self.k)
        return windows.drop("score").join(near.select(F.col("key").alias("key"), "score"), "key", "left")


def kernel_method(name: str, features: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]] | None = None, lam: float = 1e-7) -> Fit:
    """KernCD with a kernel of median bandwidth on features of the windows; ``features`` may be fitted."""

    def fit_points(x: np.ndarray) -> Score:
        f = features(x) if features else (lambda z: z)
        y = f(x)
        model = KernCD.fit_points(y, Kernel(name, gamma=bandwidth(y, name, "median")), lam)
        return lambda z: model.score_points(f(z))

    return subsample(fit_points)


@dataclass(frozen=True)
class SequenceKernel:
    """The normalized sequence kernel of flat windows over an RBF kernel."""

    width: int
    static: Kernel
    levels: int = 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = (z.reshape(len(z), self.width, -1) for z in (a, b))
        own = lambda z: np.sqrt(sequence_own(z, self.static, self.levels))
        return sequence_gram(x, y, self.static, self.levels) / np.outer(own(x), own(y))

    def diag(self, a: np.ndarray) -> np.ndarray:
        return np.ones(len(a))


def steps_gamma(windows: DataFrame, width: int) -> float:
    """What ``per_step_gamma`` is, of all windows: no pair of numbers is laid out; steps of several channels meet in blocks."""
    channels = (windows.select(F.size("w")).first() or [width])[0] // width
    if channels == 1:
        counts = windows.select(F.posexplode("w").alias("t", "x")).groupBy("t", "x").agg(F.count("*").alias("n"))
        counts = Written(windows.sparkSession, "steps").keep(counts.filter("x is not null"))
        if counts.groupBy("t").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] <= HELD_VALUES:
            held = (counts.filter(F.col("t") == t).select("x", "n").toPandas().sort_values("x") for t in range(width))  # HELD_VALUES rows
            found = [median_gap(h["x"].to_numpy(float), h["n"].to_numpy()) for h in held]
        else:
            found = [median_of_pairs(windows.select("key", F.slice("w", t + 1, 1).alias("w")), "w", "key") for t in range(width)]
    else:
        found = [median_of_pairs(windows.select("key", F.slice("w", t * channels + 1, channels).alias("w")), "w", "key") for t in range(width)]
    found = [m for m in found if m]
    return 1 / (2 * float(np.median(found)) ** 2) if found else 1.0  # all windows are equal


def sequence_method(width: int, levels: int = 2, lam: float = 1e-7) -> Fit:
    """Kernel Christoffel score of all windows under the truncated sequence kernel of an RBF kernel.

    With features phi of the kernel, ``1 - k' (K + lam n I)^-1 k`` is ``1 - phi' C (C + lam I)^-1 phi``, C the
    mean of their outer products over all n windows: one pass, no window meets another.  The
    static kernel of one channel has few features; with more channels, or where the levels
    would make more than ``SEQUENCE_FEATURES``, the Gram matrix of all windows is factored by pivots.
    """

    def fit(windows: DataFrame) -> Score:
        windows = windows.filter(F.col("w").isNotNull())
        if windows.isEmpty():
            return lambda z: np.ones(len(z))
        kernel = SequenceKernel(width, Kernel("rbf", gamma=steps_gamma(windows, width)), levels)
        static = _static_features(windows, width, kernel.static.gamma)
        if static is None or sum(static[1].shape[1] ** level for level in range(levels + 1)) > SEQUENCE_FEATURES:
            return KernCD.fit_all(windows, "w", "key", kernel, windows.count(), lam).score_points
        wave, turn = static

        def phi(x: np.ndarray) -> np.ndarray:
            own = np.sqrt(sequence_own(x[:, :, None], kernel.static, levels))
            return sequence_features(wave(x) @ turn, levels) / own[:, None]

        moments = outer_sums(windows, "w", "key", phi)
        mean, vectors = np.linalg.eigh(moments / np.trace(moments))  # a normalized window has length 1
        kept = mean > FAINT
        root = vectors[:, kept] * np.sqrt(mean[kept] / (mean[kept] + lam))
        return lambda z: 1 - np.square(phi(z) @ root).sum(1)

    return fit


def _static_features(windows: DataFrame, width: int, gamma: float) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray] | None:
    """Features of numbers for the RBF kernel, and the directions of them that all steps of all windows take; None for several channels."""
    ends = windows.select(F.size("w").alias("n"), F.array_min("w").alias("low"), F.array_max("w").alias("high")).agg(F.max("n"), F.min("low"), F.max("high")).first()
    if ends[0] != width or (ends[2] - ends[1]) ** 2 * gamma > MOST_WAVES:
        return None
    wave = waves(ends[1], ends[2], gamma)
    moments = outer_sums(windows, "w", "key", lambda x: wave(x.ravel()))
    mean, vectors = np.linalg.eigh(moments / np.trace(moments))
    return wave, vectors[:, mean > FAINT]


def gaussian_method(windows: DataFrame) -> Score:
    n, s, g = second_moment(windows, "w")
    mean = s / n
    sd = np.sqrt(np.maximum(np.diag(g) / n - mean * mean, 0)) + 1e-8
    return lambda x: np.sqrt((((x - mean) / sd) ** 2).sum(1))


def polynomial_method(degree: int, eps: float = 0.0) -> Fit:
    """Christoffel score of all monomials up to a degree; the moment matrix is a sum of block products at any width."""

    def fit(windows: DataFrame) -> Score:
        phi = lambda x: bases.features_np(x, degree, "monomial")
        n, _, g = second_moment(map_vectors(windows.select("w"), "w", phi, "phi"), "phi")
        inverse = np.linalg.pinv(g / n + eps * np.eye(len(g)), hermitian=True)
        return lambda x: np.einsum("ij,jk,ik->i", p := phi(x), inverse, p)

    return fit


def reconstruction_method(rank: int) -> Fit:
    """Stand-in for a convolutional autoencoder: reconstruction error of the leading directions of all windows."""

    def fit(windows: DataFrame) -> Score:
        n, s, g = second_moment(windows, "w")
        mean = s / n
        v = np.linalg.eigh(g / n - np.outer(mean, mean))[1][:, ::-1][:, :rank]
        return lambda x: (((x - mean) - (x - mean) @ v @ v.T) ** 2).mean(1)

    return fit


def oracle_method(failed: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, sd: np.ndarray) -> Fit:
    """Score 1 where the failure rule holds on the last step in the units before normalization, else 0."""
    return lambda _: lambda x: failed(x[:, -len(mean):] * sd + mean).astype(float)


def spectrum_map(x: np.ndarray) -> np.ndarray:
    """Magnitudes of each channel's Fourier transform over time, by the length."""
    return (np.abs(np.fft.fft(x, axis=1)) / x.shape[1]).reshape(len(x), -1)


@dataclass(frozen=True)
class KernelSpec:
    """A kernel Christoffel method: the kernel, and what makes a feature map of (n, width, D) from the fitted windows."""

    kernel: str
    features: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]] | None = None

    def fit(self, width: int) -> Fit:
        shaped = lambda x: x.reshape(len(x), width, -1)
        made = None if self.features is None else lambda x: with_seq_len(self.features(shaped(x)), width)
        return kernel_method(self.kernel, made)


#: Kernels by name; each is scored by the Christoffel function of its Gram matrix.
KERNELS = {
    "fft": KernelSpec("rbf", lambda _: spectrum_map),
    "scatter": KernelSpec("rbf", lambda x: Scattering(x.shape[1])),
    "minirocket": KernelSpec("rbf", convolution_counts),
    "rbf": KernelSpec("rbf"),
    "abel": KernelSpec("abel"),
}
#: Methods that aren't kernels on features; a width gives the fit.
OTHERS: dict[str, Callable[[int], Fit]] = {
    "sig": sequence_method,
    "conv_ae": lambda width: reconstruction_method(max(1, width // 2)),
    "gaussian": lambda _: gaussian_method,
    "knn": lambda _: lambda windows: Neighbours(windows.select("key", "w"), 5),
}
#: Degrees of the polynomial methods ``cd_poly_d<degree>``.
DEGREES = (2, 3, 4)


def method(name: str, width: int) -> Fit:
    """The fit of one of the twelve methods on windows of ``width`` steps."""
    if name in KERNELS:
        return KERNELS[name].fit(width)
    if name in OTHERS:
        return OTHERS[name](width)
    return polynomial_method(int(name.removeprefix("cd_poly_d")))


#: The twelve methods by name: a width gives the fit.
METHODS: dict[str, Callable[[int], Fit]] = {name: partial(method, name) for name in (*KERNELS, *OTHERS, *[f"cd_poly_d{d}" for d in DEGREES])}


def in_training(horizon: int) -> Column:
    """Windows that end more than ``horizon`` steps before the failure."""
    return F.col("end") + horizon < F.col("fail")


__all__ = ["METHODS", "as_sequence", "median_distance", "scored", "subsample", "with_seq_len"]
