"""Kernels on whole trajectories, temporal kernels, and convolution features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import Kernel, squared_distances
from .reduction import random_fourier


@dataclass(frozen=True)
class TemporalKernel:
    """rbf, matern12, matern32, matern52 or periodic on time points; sums and products by ``+`` and ``*``."""

    fn: Callable[[np.ndarray], np.ndarray]

    @staticmethod
    def of(name: str, scale: float = 1.0, period: float = 1.0) -> TemporalKernel:
        def fn(d: np.ndarray) -> np.ndarray:
            r = np.abs(d) / scale
            return {"rbf": lambda: np.exp(-r * r / 2), "matern12": lambda: np.exp(-r), "matern32": lambda: (1 + np.sqrt(3) * r) * np.exp(-np.sqrt(3) * r),
                    "matern52": lambda: (1 + np.sqrt(5) * r + 5 * r * r / 3) * np.exp(-np.sqrt(5) * r), "periodic": lambda: np.exp(-2 * np.sin(np.pi * d / period) ** 2 / scale**2)}[name]()

        return TemporalKernel(fn)

    def __add__(self, other: TemporalKernel) -> TemporalKernel:
        return TemporalKernel(lambda d: self.fn(d) + other.fn(d))

    def __mul__(self, other: TemporalKernel) -> TemporalKernel:
        return TemporalKernel(lambda d: self.fn(d) * other.fn(d))

    def matrix(self, t: np.ndarray) -> np.ndarray:
        return self.fn(t[:, None] - t[None, :])

    def smoother(self, t: np.ndarray, ridge: float) -> np.ndarray:
        k = self.matrix(t)
        return k @ np.linalg.inv(k + ridge * np.eye(len(t)))

    def low_rank(self, t: np.ndarray, rank: int) -> np.ndarray:
        """Leading eigenvectors times root eigenvalues."""
        w, v = np.linalg.eigh(self.matrix(t))
        order = np.argsort(w)[::-1][:rank]
        return v[:, order] * np.sqrt(np.maximum(w[order], 0))


def spatiotemporal(x: np.ndarray, y: np.ndarray, temporal: np.ndarray, spatial: Kernel) -> np.ndarray:
    """Sum over time pairs of temporal weight times spatial kernel, for (n, T, D) and (m, T, D)."""
    (n, steps, _), (m, others, _) = x.shape, y.shape
    out, flat = np.empty((n, m)), y.reshape(m * others, -1)
    part = max(1, (1 << 22) // (m * steps * others))
    for at in range(0, n, part):
        rows = x[at:at + part]
        values = spatial(rows.reshape(len(rows) * steps, -1), flat).reshape(len(rows), steps, m, others)
        out[at:at + part] = (values * temporal[None, :, None, :]).sum((1, 3))
    return out


def sum_kernel(x: np.ndarray, y: np.ndarray, spatial: Kernel) -> np.ndarray:
    """The same with weight on equal times only."""
    return sum(spatial(x[:, t], y[:, t]) for t in range(x.shape[1]))


def mean_embedding(states: DataFrame, channels: Sequence[str], gamma: float, m: int = 512, seed: int = 0) -> DataFrame:
    """(ep, phi): mean random Fourier features of each episode's states; partial sums before the exchange."""
    import pandas as pd

    f = random_fourier(len(channels), gamma, m, seed)

    def partial(batches):
        for pdf in batches:
            pdf = pdf.dropna()
            if len(pdf):
                phi = f(pdf[list(channels)].to_numpy(float))
                code, eps = pd.factorize(pdf["ep"])
                sums = np.zeros((len(eps), m))
                np.add.at(sums, code, phi)
                yield pd.DataFrame({"ep": eps, "n": np.bincount(code), "s": list(sums)})

    parts = states.select("ep", *channels).mapInPandas(partial, "ep long, n long, s array<double>")
    long = parts.select("ep", "n", F.posexplode("s").alias("i", "v")).groupBy("ep", "i").agg((F.sum("v") / F.sum("n")).alias("v"))
    return long.groupBy("ep").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("phi"))  # m values an episode


def composite(parts: Sequence[tuple[Sequence[int], float]], mode: str = "product") -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Product or mean of RBF kernels on groups of columns, each with its own gamma."""

    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        blocks = [np.exp(-g * squared_distances(a[:, list(c)], b[:, list(c)])) for c, g in parts]
        return np.prod(blocks, axis=0) if mode == "product" else np.mean(blocks, axis=0)

    return k


def fit_gammas(x: np.ndarray, groups: Sequence[Sequence[int]]) -> list[float]:
    """One over the median squared distance of each group of columns."""
    out = []
    for g in groups:
        d = squared_distances(x[:, list(g)], x[:, list(g)])[np.triu_indices(len(x), 1)]
        out.append(float(1 / np.median(d[d > 0])))
    return out


#: Taps of a convolution and how many of them weigh 2 (the others -1): 84 choices.
TAPS, HEAVY = 9, 3
#: Fractional part of the golden mean: multiples of it fill 0 .. 1 evenly.
GOLDEN = (5**0.5 - 1) / 2


def convolution_map(x: np.ndarray, n_features: int = 9996, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """A map of windows (n, T, D) to ``n_features`` shares of positive values of dilated convolutions."""
    counts, length = convolution_counts(x, n_features, seed), x.shape[1]
    return lambda z: counts(z).astype(float) / length


def convolution_counts(x: np.ndarray, n_features: int = 9996, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """The same as numbers of steps: whole, and in single precision where a sum of their squares is exact in it.

    The 84 choices of taps are spread over dilations that fit the length, each with a
    drawn subset of the channels whose responses are summed; biases are quantiles,
    evenly spread, of the response on drawn rows of the fitted ``x``.
    """
    from itertools import combinations

    x = x if x.ndim == 3 else x[:, :, None]
    taps, (_, length, depth) = np.array(list(combinations(range(TAPS), HEAVY))), x.shape
    per = max(1, n_features // len(taps))
    most = max(1.0, (length - 1) / (TAPS - 1))
    dilations, counts = np.unique(np.floor(2 ** np.linspace(0, np.log2(most), min(per, 32))).astype(int), return_counts=True)
    share = np.floor(np.cumsum(counts) / counts.sum() * per).astype(int)
    counts = np.diff(np.concatenate(([0], share)))
    rng = np.random.default_rng(seed)
    widest = np.log2(min(depth, TAPS) + 1)
    subsets = [[rng.choice(depth, int(2 ** rng.uniform(0, widest)), replace=False) for _ in taps] for _ in dilations]

    def outputs(z: np.ndarray, which: int):
        """The response (n, T) of each choice of taps at a dilation."""
        d = int(dilations[which])
        reach = (TAPS // 2) * d
        pad = np.pad(z, ((0, 0), (reach, reach), (0, 0)))
        shifts = np.stack([pad[:, i * d:i * d + length] for i in range(TAPS)])
        total = -shifts.sum(0)
        for pick, channels in zip(taps, subsets[which], strict=True):
            yield (total[:, :, channels] + (1 + 2) * shifts[pick][:, :, :, channels].sum(0)).sum(2)

    biases, used = [], 0
    for which, c in enumerate(counts):
        every = []
        for k in range(len(taps)):
            every.append((rng.integers(len(x)), (np.arange(used, used + c) + 1) * GOLDEN % 1))
            used += c
        responses = outputs(x, which)
        biases.append([np.quantile(out[row], shares) for out, (row, shares) in zip(responses, every, strict=True)])

    kind = np.float32 if 4 * per * len(taps) * length**2 < 1 << 24 else float

    def features(z: np.ndarray) -> np.ndarray:
        z = z if z.ndim == 3 else z[:, :, None]
        found, at = np.zeros((len(z), used), dtype=kind), 0
        for which, every in enumerate(biases):
            for out, each in zip(outputs(z, which), every, strict=True):
                for step in out.T:
                    found[:, at:at + len(each)] += step[:, None] > each
                at += len(each)
        return found

    return features


class Scattering:
    """Wavelet scattering of windows (n, T, D): moduli of a Morlet cascade, averaged by a low pass and over time.

    The first order has ``per_octave`` wavelets in each of ``octaves`` octaves, the second
    one; a second-order path goes down in frequency.  Windows are reflected to a power of two, filters live in the Fourier
    domain, and a modulus is kept at the rate that its band needs.  The bank of an order
    is scaled so that its squared responses sum to at most 1 at every frequency, so no
    step adds energy.
    """

    #: Highest centre, and widths of a wavelet and of the low pass at one per octave.
    TOP, WIDTH, LOW = 0.35, 0.4, 0.1

    def __init__(self, length: int, octaves: int = 6, per_octave: int = 1, order: int = 2):
        self.length, self.order = length, order
        self.octaves = max(1, min(octaves, int(np.log2(length))))
        self.size = 1 << int(np.ceil(np.log2(2 * length)))
        self.low = self._gauss(0.0, self.LOW * 2.0 ** (1 - self.octaves))
        self.first = self._bank(per_octave)
        self.second = self._bank(1)

    def _gauss(self, centre: float, width: float) -> np.ndarray:
        f = np.fft.fftfreq(self.size)
        return sum(np.exp(-0.5 * ((f - centre + k) / width) ** 2) for k in (-1, 0, 1))  # frequencies wrap around

    def _bank(self, per_octave: int) -> list[tuple[float, np.ndarray]]:
        found = []
        for j in range(self.octaves * per_octave):
            centre = self.TOP * 2.0 ** (-j / per_octave)
            width = max(centre * self.WIDTH / per_octave, self.LOW * 2.0 ** (1 - self.octaves))
            band, still = self._gauss(centre, width), self._gauss(0.0, width)
            found.append((centre, band - band[0] / still[0] * still))  # no response to a constant
        scale = np.sqrt(((self.energy(found) - self.low**2) / np.maximum(1 - self.low**2, 1e-9)).max())
        return [(c, b / scale) for c, b in found]

    def energy(self, bank: list[tuple[float, np.ndarray]]) -> np.ndarray:
        """Sum of squared responses at each frequency, of real signals."""
        mirrored = lambda b: np.roll(b[::-1], 1)
        return self.low**2 + sum(b**2 + mirrored(b) ** 2 for _, b in bank) / 2

    @staticmethod
    def _folded(spectrum: np.ndarray, rate: int) -> np.ndarray:
        """The spectrum of every ``rate``-th value."""
        return spectrum.reshape(*spectrum.shape[:-1], rate, -1).mean(-2)

    def _averaged(self, spectrum: np.ndarray, rate: int) -> np.ndarray:
        low = np.fft.ifft(spectrum * self._folded(self.low * rate, rate)).real
        return low[..., :max(1, self.length // rate)].mean(-1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Features (n, D * paths), channel by channel."""
        x = x if x.ndim == 3 else x[:, :, None]
        n, length, depth = x.shape
        rows = x.transpose(0, 2, 1).reshape(n * depth, length)
        both = np.concatenate((rows, rows[:, ::-1]), axis=1)
        spectrum = np.fft.fft(np.pad(both, ((0, 0), (0, self.size - 2 * length)), mode="wrap"))
        out = [self._averaged(spectrum, 1)]
        for centre, band in self.first:
            rate = self._rate(centre)
            modulus = np.fft.fft(np.abs(np.fft.ifft(self._folded(spectrum * band, rate))))
            out.append(self._averaged(modulus, rate))
            for lower, below in self.second if self.order > 1 else ():
                if lower < centre:
                    next_rate = max(rate, self._rate(lower))
                    folded = self._folded(modulus * self._folded(below * rate, rate), next_rate // rate)
                    out.append(self._averaged(np.fft.fft(np.abs(np.fft.ifft(folded))), next_rate))
        return np.column_stack(out).reshape(n, -1)

    def _rate(self, centre: float) -> int:
        """Values that may be left out between two kept ones: a power of two below the band's reach."""
        rate = 1
        while centre * (1 + 3 * self.WIDTH) * 2 * rate < 0.5 and rate * 2 <= self.size // 4:
            rate *= 2
        return rate


def count_sketch(x: np.ndarray, degree: int, width: int, seed: int = 0) -> np.ndarray:
    """Tensor sketch of the polynomial kernel ``⟨x, y⟩^degree``: count sketches multiplied in the Fourier domain."""
    rng, prod = np.random.default_rng(seed), None
    for _ in range(degree):
        h, s = rng.integers(0, width, x.shape[1]), rng.choice([-1.0, 1.0], x.shape[1])
        c = np.zeros((width, len(x)))
        np.add.at(c, h, s[:, None] * x.T)
        f = np.fft.fft(c.T, axis=1)
        prod = f if prod is None else prod * f
    return np.fft.ifft(prod, axis=1).real
