"""Operators on pairs of vectors: kernels, neighbours, two-sample statistics.

``against`` compares every row with a *reference set* of a size that the caller
names (a fit set, landmarks), sent with the task; ``meet`` compares all rows of two
tables in blocks.  Either way an Arrow batch or a pair of blocks is one product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement
from math import comb, factorial, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Written
from .episodes import subsample

#: Rows that make a block of their own in ``meet``, blocks that a side is cut into while they hold no more than
#: ``HELD_ROWS`` (which bounds a task's memory), and rows of a product inside a task.
BLOCK_ROWS, SIDE, HELD_ROWS, TILE = 1000, 8, 1 << 18, 500
#: Rows that are compared with a reference set at once.
AGAINST_ROWS = 256
#: Moments of all rows that the mean of a power of dot products is read from, at most; with more of them all rows meet.
MOMENTS = 1 << 18
Block = Callable[[np.ndarray, np.ndarray], np.ndarray]


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As doubles; single precision is for whole numbers, of which it makes exact ones."""
    own, others, both = (a * a).sum(1).astype(float, copy=False), (b * b).sum(1).astype(float, copy=False), (2 * a) @ b.T
    out = own[:, None] + others[None, :]
    out -= both
    return np.maximum(out, 0.0, out=out)


def absolute_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences, a row against some of the others at a time: no array has all three sides.

    A difference is the sum less twice the lesser number, taken about the middle of ``b``, so that rounding is of the spread.
    """
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return np.array([np.abs(row - b).sum(1) for row in a]).reshape(len(a), len(b))
    out, size = np.empty((len(a), len(b))), a.shape[1]
    if not out.size or not size:
        return np.zeros((len(a), len(b)))
    centre = np.median(b, axis=0)
    a, b, twice = a - centre, b - centre, np.full(size, -2.0)
    part = max(1, (1 << 15) // size)
    for at in range(0, len(b), part):
        rows = np.ascontiguousarray(b[at:at + part])
        least = np.empty_like(rows)
        flat, lesser = rows.ravel(), least.ravel()
        for row, into in zip(a, out[:, at:at + part]):
            least[:] = row
            np.minimum(lesser, flat, out=lesser)
            np.dot(least, twice, out=into)
    out += a.sum(1)[:, None]
    out += b.sum(1)
    return np.maximum(out, 0.0, out=out)


@dataclass(frozen=True)
class Kernel:
    """A kernel by name with fixed parameters: a block function and its diagonal."""

    name: str
    gamma: float = 1.0
    c: float = 1.0
    degree: int = 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.name == "rbf":
            out = squared_distances(a, b)
            out *= -self.gamma
            return np.exp(out, out=out)
        if self.name == "abel":
            return np.exp(-self.gamma * np.sqrt(squared_distances(a, b)))
        if self.name == "laplace":
            return np.exp(-self.gamma * absolute_distances(a, b))
        if self.name == "linear":
            return a @ b.T + self.c
        if self.name == "poly":
            return (self.gamma * (a @ b.T) + self.c) ** self.degree
        if self.name in ("polyfft", "gaussfft"):
            fa, fb = self.features(a), self.features(b)
            return (1 + fa @ fb.T) ** self.degree if self.name == "polyfft" else np.exp(-self.gamma * squared_distances(fa, fb))
        raise ValueError(f"unknown kernel {self.name}")

    def of_distances(self, d2: np.ndarray) -> np.ndarray:
        """Values of an RBF or Abel kernel at squared distances."""
        return np.exp(-self.gamma * (d2 if self.name == "rbf" else np.sqrt(d2)))

    def features(self, a: np.ndarray) -> np.ndarray:
        """What the kernel takes of each row: magnitudes of its Fourier transform, or the row itself."""
        return np.abs(np.fft.fft(a, axis=1)) / a.shape[1] if self.name in ("polyfft", "gaussfft") else a

    def power(self) -> tuple[float, float, int] | None:
        """(scale, shift, degree) of a kernel that is ``(scale * <x, y> + shift) ** degree`` of its features, else None."""
        if self.name in ("poly", "polyfft") and self.degree in range(1, 10):
            return (self.gamma, self.c, int(self.degree)) if self.name == "poly" else (1.0, 1.0, int(self.degree))
        return (1.0, self.c, 1) if self.name == "linear" else None

    def diag(self, a: np.ndarray) -> np.ndarray:
        if self.name in ("rbf", "abel", "laplace", "gaussfft"):
            return np.ones(len(a))
        if self.name == "linear":
            return (a * a).sum(1) + self.c
        if self.name == "poly":
            return (self.gamma * (a * a).sum(1) + self.c) ** self.degree
        f = self.features(a)
        return (1 + (f * f).sum(1)) ** self.degree


def reference(df: DataFrame, vector: str, key: str, n: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, matrix) of at most ``n`` rows, the first in shuffled order, sorted by key: a fit set, held by the driver."""
    rows = subsample(df.select(key, vector).filter(F.col(vector).isNotNull()), n, seed, key).toPandas().sort_values(key)
    return rows[key].to_numpy(), np.array(rows[vector].tolist(), dtype=float).reshape(len(rows), -1)


def against(df: DataFrame, vector: str, key: str, fn: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, carry: Sequence[str] = ()) -> DataFrame:
    """One output row per row of ``df``: ``fn(keys, block)`` gives the columns of ``schema``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AGAINST_ROWS):  # features and values are many times a block's size
                pdf = batch.iloc[at:at + AGAINST_ROWS]
                block = np.array(pdf[vector].tolist(), dtype=float).reshape(len(pdf), -1)
                yield pd.DataFrame({key: pdf[key], **{c: pdf[c] for c in carry}, **fn(pdf[key].to_numpy(), block)})

    kinds = dict(df.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in (key, *carry))
    return df.select(key, *carry, vector).filter(F.col(vector).isNotNull()).mapInPandas(work, f"{head}, {schema}")


def gram_stats(df: DataFrame, vector: str, key: str, kernel: Kernel, ref: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: mean kernel value against the reference, and the same without itself."""
    keys, m = ref

    def fn(k: np.ndarray, block: np.ndarray) -> dict[str, np.ndarray]:
        g = kernel(block, m)
        own = k[:, None] == keys[None, :]
        return {"k_mean": g.mean(1), "k_sum_other": np.where(own, 0.0, g).sum(1), "k_self": kernel.diag(block)}

    return against(df, vector, key, fn, "k_mean double, k_sum_other double, k_self double")


def knn(df: DataFrame, vector: str, key: str, ref: tuple[np.ndarray, np.ndarray], k: int, skip_self: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Mean, k-th and least distance to the k nearest reference rows."""
    keys, m = ref

    def fn(ids: np.ndarray, block: np.ndarray) -> dict[str, np.ndarray]:
        d = np.sqrt(np.maximum(squared_distances(block, m), 0))
        same = ids[:, None] == keys[None, :]
        d = np.where(same, np.inf if skip_self else 0.0, d)
        part = np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
        return {"score": part.mean(1), "kth": part[:, -1], "nearest": part[:, 0]}

    return against(df, vector, key, fn, "score double, kth double, nearest double", carry)


def median_distance(ref: np.ndarray, neighbours: int = 0) -> float:
    """Median of the positive distances in a reference set, or of those to the ``neighbours``-th nearest."""
    d = np.sqrt(squared_distances(ref, ref))
    if neighbours:
        np.fill_diagonal(d, np.inf)
        d = np.sort(d, axis=1)[:, neighbours - 1]
        return float(np.median(d[np.isfinite(d) & (d > 0)]))
    d = d[np.triu_indices(len(d), 1)]
    return float(np.median(d[d > 0]))


#: Parts that an interval of distances is cut into by a pass, and distances that reach the driver at most.
PARTS, FEW_DISTANCES = 1 << 14, 100_000


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of row by row, coordinate by coordinate: a pair's distance doesn't depend on the block that it is met in."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += np.square(x[:, k] - y[:, k])
    return np.sqrt(total)


def median_of_pairs(df: DataFrame, vector: str, key: str) -> float | None:
    """The exact median of the positive distances between all pairs of rows (one a key); null if there are none.

    The first pass counts distances, known up to the rounding of a product, in parts of
    their range; the next ones count those of the part that holds the middle ones, by
    themselves, until few are left, which are ordered.  No pair is laid out, whatever
    the number of passes, and no row is left out.
    """
    rows = df.select(key, F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull())
    ends = rows.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("k").toPandas()  # a row a coordinate
    spread = float(np.sqrt(np.square(ends["high"] - ends["low"]).sum()))
    if not spread:
        return None
    centre, size = ((ends["high"] + ends["low"]) / 2).to_numpy(), len(ends)
    slack = 16 * (size + 4) * np.finfo(float).eps * spread**2  # of a squared distance by a product of centred rows

    def products(p: pd.DataFrame, x: np.ndarray, q: pd.DataFrame, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(squared distances, left rows, right rows) of each tile; a pair that is none of its own is at infinity."""
        same, u, v = p["__l"].iloc[0] == q["__r"].iloc[0], x - centre, y - centre
        ids, others = p[key].to_numpy(), q[key].to_numpy()
        for i, j in tiles(len(x), len(y)):
            d2 = squared_distances(u[i], v[j])
            if same:
                d2[~(ids[i, None] < others[None, j])] = np.inf
            yield d2, x[i], y[j]

    def exact(d2: np.ndarray, x: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
        """The positive distances of the pairs whose squared ones may lie between ``low`` and ``high``."""
        i, j = np.nonzero((d2 >= low - slack) & (d2 <= high + slack))
        d = _distances(x[i], y[j])
        return d[d > 0]

    top = (spread * (1 + 1e-9)) ** 2 + 4 * slack

    def roughly(p: pd.DataFrame, x: np.ndarray, q: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        n = np.zeros(PARTS, dtype=np.int64)
        for d2, a, b in products(p, x, q, y):
            near = d2 <= slack
            if near.any():  # some of these are 0
                n += np.bincount(np.minimum((np.square(exact(d2, a, b, -np.inf, 0.0)) / top * PARTS).astype(np.int64), PARTS - 1), minlength=PARTS)
            far = d2[~near & (d2 < np.inf)] if near.any() or d2.max() == np.inf else d2.ravel()
            n += np.bincount(np.minimum((far * (PARTS / top)).astype(np.int32), PARTS - 1), minlength=PARTS)
        has = np.flatnonzero(n)
        return pd.DataFrame({"part": has, "n": n[has]})

    def counted(low: float, high: float) -> pd.DataFrame:
        def fn(p: pd.DataFrame, x: np.ndarray, q: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
            n, under, least, most = np.zeros(PARTS, dtype=np.int64), 0, np.full(PARTS, np.inf), np.full(PARTS, -np.inf)
            for d2, a, b in products(p, x, q, y):
                d = exact(d2, a, b, low * low, high * high)
                if low * low > 2 * slack:
                    below = int((d2 < low * low - slack).sum())
                    zeros = d2 <= slack
                    under += below - int(zeros.sum()) + (len(exact(d2, a, b, -np.inf, 0.0)) if zeros.any() else 0)
                    under += int((d < low).sum())
                else:
                    under += int((exact(d2, a, b, -np.inf, low * low) < low).sum())
                d = d[(d >= low) & (d <= high)]
                part = np.minimum(((d - low) / (high - low) * PARTS).astype(np.int64), PARTS - 1) if high > low else np.zeros(len(d), np.int64)
                np.minimum.at(least, part, d)
                np.maximum.at(most, part, d)
                n += np.bincount(part, minlength=PARTS)
            has = np.flatnonzero(n)
            return pd.DataFrame({"part": np.append(has, -1), "n": np.append(n[has], under), "least": np.append(least[has], 0.0), "most": np.append(most[has], 0.0)})

        sums = meet(rows, rows, vector, key, fn, "part long, n long, least double, most double", once=True)
        return sums.groupBy("part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).toPandas().sort_values("part")  # PARTS rows

    def held(low: float, high: float) -> np.ndarray:
        def fn(p: pd.DataFrame, x: np.ndarray, q: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
            found = [exact(*tile, low * low, high * high) for tile in products(p, x, q, y)]
            d = np.concatenate(found) if found else np.zeros(0)
            return pd.DataFrame({"d": d[(d >= low) & (d <= high)]})

        return np.sort([r["d"] for r in meet(rows, rows, vector, key, fn, "d double", once=True).collect()])

    rough = meet(rows, rows, vector, key, roughly, "part long, n long", once=True).groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")  # PARTS rows
    total = int(rough["n"].sum())
    if not total:
        return None
    ranks = sorted({(total - 1) // 2, total // 2})
    place = lambda table: [min(int(np.searchsorted(table["n"].cumsum().to_numpy(), r, side="right")), len(table) - 1) for r in ranks]
    first, last = (int(rough["part"].iloc[at]) for at in (place(rough)[0], place(rough)[-1]))
    low, high = np.sqrt(max(first / PARTS * top - 2 * slack, 0.0)), np.sqrt((last + 1) / PARTS * top + 2 * slack)
    while True:
        table = counted(float(low), float(high))
        run, at = table["n"].cumsum().to_numpy(), place(table)
        inside = table.iloc[at[0]:at[-1] + 1]
        low, high = float(inside["least"].min()), float(inside["most"].max())
        if (inside["least"] == inside["most"]).all():
            return float(np.mean([table["least"].iloc[i] for i in at]))
        if inside["n"].sum() <= FEW_DISTANCES:
            before = int(run[at[0]] - table["n"].iloc[at[0]])
            return float(np.mean(held(low, high)[[r - before for r in ranks]]))


def bandwidth_of_all(df: DataFrame, vector: str, key: str, kernel: str, heuristic: str = "median") -> float | None:
    """gamma of a kernel by the rules of ``bandwidth``, from all rows instead of a fit set."""
    from .metrics import quantiles

    if heuristic == "dimension":
        return bandwidth(np.zeros((1, df.select(F.max(F.size(vector))).first()[0])), kernel, heuristic)
    if heuristic == "median":
        med = median_of_pairs(df, vector, key)
    else:
        near = knn_all(df, df, vector, key, {"median_nn": 1, "median_5nn": 5}[heuristic], skip_self=True)
        med = quantiles(near.filter("kth > 0"), "kth", [0.5])[0]
    return None if med is None else 1 / (2 * med**2) if kernel in ("rbf", "gaussfft") else 1 / med


def bandwidth(ref: np.ndarray, kernel: str, heuristic: str) -> float:
    """gamma of a kernel by a rule: median, median_nn, median_5nn or dimension."""
    d = ref.shape[1]
    if heuristic == "dimension":
        return {"rbf": 1 / (2 * d), "laplace": 1 / d, "abel": 1 / np.sqrt(d), "poly": 1 / d}[kernel]
    med = median_distance(ref, {"median": 0, "median_nn": 1, "median_5nn": 5}[heuristic])
    return 1 / (2 * med**2) if kernel in ("rbf", "gaussfft") else 1 / med


def tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """Rows and columns of the products that an n x m block is made of."""
    for i in range(0, n, TILE):
        for j in range(0, m, TILE):
            yield slice(i, min(i + TILE, n)), slice(j, min(j + TILE, m))


def _own(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Where keys are equal, or None if none are."""
    return a[:, None] == b[None, :] if np.isin(a, b).any() else None


def meet(left: DataFrame, right: DataFrame, vector: str, key: str, fn: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, size: int = BLOCK_ROWS, *, by: Sequence[str] = (), once: bool = False) -> DataFrame:
    """Union of ``fn(a, x, b, y)`` over all pairs of a block of left rows and one of right rows; x and y are their vectors.

    With ``by`` only rows of equal ``by`` columns meet, each group in blocks of its own.
    With ``once`` a table that meets itself does so by each pair of blocks in one order
    alone; where a block meets itself, ``fn`` still gets it on both sides.

    Blocks are cut by a hash of the key; every row goes to as many tasks as the other
    side has blocks.  These are at most ``SIDE``, so that copies grow with the rows, until
    a block would hold more than ``HELD_ROWS``; groups of ``by`` are cut beyond that alone.
    ``fn`` goes through its two blocks in ``tiles``.
    """
    largest = lambda df: df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0

    def parts(df: DataFrame) -> int:
        rows = largest(df) if by else df.count()
        return max(1, min(-(-rows // size), 1 if by else SIDE), -(-rows // HELD_ROWS))

    left, right = (df.filter(F.col(vector).isNotNull()) for df in (left, right))
    n = parts(left)
    m = n if once else parts(right)
    own = lambda k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = lambda low, high: F.explode(F.sequence(low, high))
    a = left.withColumn("__l", own(n)).select("*", every(F.col("__l") if once else F.lit(0), F.lit(m - 1)).alias("__r"))
    b = right.select(*[F.col(c).alias(c) for c in right.columns]).withColumn("__r", own(m)).select("*", every(F.lit(0), F.col("__r") if once else F.lit(n - 1)).alias("__l"))  # a table may meet itself
    matrix = lambda pdf: np.array(pdf[vector].tolist(), dtype=float).reshape(len(pdf), -1)

    def work(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return fn(p, matrix(p), q, matrix(q))

    return a.groupBy(*by, "__l", "__r").cogroup(b.groupBy(*by, "__l", "__r")).applyInPandas(work, schema)


def _of_both(p: pd.DataFrame, q: pd.DataFrame) -> bool:
    """Whether a pair of blocks that meets once is two blocks, so that its result is for the rows of both."""
    return p["__l"].iloc[0] != q["__r"].iloc[0]


def _terms(size: int, degree: int) -> np.ndarray:
    """The products of ``degree`` of ``size`` coordinates, a column of coordinates each, those in another order left out."""
    return np.array(list(combinations_with_replacement(range(size), degree)), dtype=int).reshape(comb(size + degree - 1, degree), degree).T


def _products(columns: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Values (terms, rows) of products of coordinates, which are the rows of ``columns``."""
    out = np.ones((terms.shape[1], columns.shape[1]))
    for at in terms:
        out *= columns[at]
    return out


def _orders(terms: np.ndarray) -> np.ndarray:
    """In how many orders each product comes."""
    return np.array([factorial(len(t)) // prod(factorial(t.count(k)) for k in set(t)) for t in terms.T.tolist()], dtype=float)


def gram_by_moments(df: DataFrame, fitted: DataFrame, vector: str, key: str, kernel: Kernel) -> DataFrame | None:
    """What ``gram_all`` gives, without a pair, for a kernel that is a power of dot products; None for others.

    With x and y the features, ``(scale * <x, y> + shift) ** degree`` is ``<u, w> ** degree``
    for u = (x, 1) and w = (scale * y, shift), a sum of products of coordinates of u times those of w, so its
    mean over all y takes the mean products of w alone: one pass of bounded sums.
    """
    from .reduction import summed_blocks

    power = kernel.power()
    one = power and fitted.select(F.size(vector)).filter(F.col(vector).isNotNull()).first()
    if not one:
        return None
    (scale, shift, degree), size = power, one[0] + 1
    high, low = degree - degree // 2, degree // 2
    if comb(size + high - 1, high) * comb(size + low - 1, low) > MOMENTS:
        return None
    high, low = _terms(size, high), _terms(size, low)

    def sums(y: np.ndarray) -> np.ndarray:
        total = np.zeros((high.shape[1], low.shape[1]))
        for at in range(0, len(y), AGAINST_ROWS):
            part = kernel.features(y[at:at + AGAINST_ROWS]).T
            w = np.vstack((scale * part, np.full(part.shape[1], shift)))
            total += _products(w, high) @ _products(w, low).T
        return np.append(total.ravel(), len(y))

    *total, n = summed_blocks(fitted, vector, sums)
    mean = np.reshape(total, (high.shape[1], low.shape[1])) / n * _orders(high)[:, None] * _orders(low)

    def fn(_: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        u = np.vstack((kernel.features(x).T, np.ones(len(x))))
        return {"k_mean": (mean.T @ _products(u, high) * _products(u, low)).sum(0), "k_self": kernel.diag(x)}

    means = against(df, vector, key, fn, "k_mean double, k_self double")
    return means.groupBy(key).agg(F.avg("k_mean").alias("k_mean"), F.max("k_self").alias("k_self"))


def gram_all(df: DataFrame, fitted: DataFrame, vector: str, key: str, kernel: Kernel) -> DataFrame:
    """(key, k_mean, k_self): mean kernel value of each row against all ``fitted`` rows, and with itself.

    A power of dot products takes moments of the fitted rows; for any other kernel all
    rows meet and, where ``fitted`` is ``df`` itself, a pair's value is made once for both rows.
    """
    moments = gram_by_moments(df, fitted, vector, key, kernel)
    if moments is not None:
        return moments
    kind, once = dict(df.dtypes)[key], fitted is df

    def fn(p: pd.DataFrame, x: np.ndarray, q: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        own, ids, others = kernel.diag(x), p[key].to_numpy(), q[key].to_numpy()
        s, t = np.zeros(len(p)), np.zeros(len(q))
        for i, j in tiles(len(p), len(q)):
            g, same = kernel(x[i], y[j]), _own(ids[i], others[j])
            if same is not None:
                g = np.where(same, own[i, None], g)  # a row's distance to itself is 0, without rounding
            s[i] += g.sum(1)
            t[j] += g.sum(0)
        out = pd.DataFrame({key: p[key], "s": s, "n": len(q), "k_self": own})
        return pd.concat([out, pd.DataFrame({key: q[key], "s": t, "n": len(p), "k_self": kernel.diag(y)})]) if once and _of_both(p, q) else out

    left = df.select(key, vector)
    sums = meet(left, left if once else fitted.select(key, vector), vector, key, fn, f"{key} {kind}, s double, n long, k_self double", once=once)
    return sums.groupBy(key).agg((F.sum("s") / F.sum("n")).alias("k_mean"), F.max("k_self").alias("k_self"))


def _nearer(best: np.ndarray, d2: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Puts the squared distances of x to the nearest of y among the least ones so far, which are ordered; the ones that stay are exact."""
    k = best.shape[1]
    rows = np.flatnonzero(d2.min(1) < best[:, -1])
    if not len(rows):
        return
    part = d2[rows]
    at = np.argpartition(part, k - 1, axis=1)[:, :k] if k < part.shape[1] else np.broadcast_to(np.arange(part.shape[1]), part.shape)
    new = np.square(x[rows][:, None, :] - y[at]).sum(2)
    found = np.take_along_axis(part, at, axis=1)
    new[(found == np.inf) | (found < 0)] = 0.0
    new[found == np.inf] = np.inf
    best[rows] = np.sort(np.concatenate((best[rows], new), axis=1), axis=1)[:, :k]


def knn_all(df: DataFrame, fitted: DataFrame, vector: str, key: str, k: int, skip_self: bool = False) -> DataFrame:
    """(key, score, kth, nearest) of each row among all ``fitted`` rows: the k nearest of each block, then of all.

    Where ``fitted`` is ``df`` itself, a pair's distance is made once for both rows.
    """
    kind, once = dict(df.dtypes)[key], fitted is df

    def fn(p: pd.DataFrame, x: np.ndarray, q: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        ids, others, both = p[key].to_numpy(), q[key].to_numpy(), once and _of_both(p, q)
        best, turned = np.full((len(p), k), np.inf), np.full((len(q) if both else 0, k), np.inf)
        for i, j in tiles(len(p), len(q)):
            d2, same = squared_distances(x[i], y[j]), _own(ids[i], others[j])
            if same is not None:
                d2 = np.where(same, np.inf if skip_self else -1.0, d2)  # its own distance is 0
            _nearer(best[i], d2, x[i], y[j])
            if both:
                _nearer(turned[j], d2.T, y[j], x[i])
        near = lambda ids, d2: pd.DataFrame({key: ids, "near": list(np.sqrt(d2))})
        return pd.concat([near(p[key], best), near(q[key], turned)]) if both else near(p[key], best)

    left = df.select(key, vector)
    near = meet(left, left if once else fitted.select(key, vector), vector, key, fn, f"{key} {kind}, near array<double>", once=once)
    best = near.groupBy(key).agg(F.slice(F.array_sort(F.filter(F.flatten(F.collect_list("near")), lambda d: d < float("inf"))), 1, k).alias("d"))  # k a block
    return best.select(key, (F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / F.size("d")).alias("score"), F.try_element_at("d", F.lit(-1)).alias("kth"), F.try_element_at("d", F.lit(1)).alias("nearest"))


def mmd2(df: DataFrame, vector: str, key: str, label: Column, kernel: Kernel, by: Sequence[str] = ()) -> DataFrame:
    """Unbiased squared MMD between all rows where ``label`` holds and all others: block sums of the kernel.

    Equal vectors of a group meet as one, weighed by the rows of either side.  With ``by``
    one value for each group of rows; null where a side has fewer than two rows.
    """
    rows = df.select(*by, F.col(vector).cast("array<double>").alias(vector), label.cast("long").alias("y")).filter(F.col("y").isNotNull() & F.col(vector).isNotNull())
    counts = rows.groupBy(*by, vector).agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    rows = Written(df.sparkSession, "mmd").keep(counts.withColumn("__at", F.xxhash64(vector)))
    kinds = dict(rows.dtypes)

    def fn(p: pd.DataFrame, x: np.ndarray, q: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        u, v, a, b = (c.to_numpy(float) for c in (p["n1"], p["n0"], q["n1"], q["n0"]))
        both, own, ids, others = _of_both(p, q), kernel.diag(x), p["__at"].to_numpy(), q["__at"].to_numpy()
        s11, s00, s10 = 0.0, 0.0, 0.0
        for i, j in tiles(len(p), len(q)):
            g, same = kernel(x[i], y[j]), None if both else _own(ids[i], others[j])
            if same is not None:
                g = np.where(same, own[i, None], g)
            ga, gb = g @ a[j], g @ b[j]
            s11, s00, s10 = s11 + u[i] @ ga, s00 + v[i] @ gb, s10 + (u[i] @ gb + (v[i] @ ga if both else 0.0))
        if both:
            s11, s00 = 2 * s11, 2 * s00
        else:  # a row and itself are no pair
            s11, s00 = s11 - u @ own, s00 - v @ own
        return pd.DataFrame({**{c: p[c].iloc[:1].to_numpy() for c in by}, "s11": [s11], "s00": [s00], "s10": [s10]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "s11 double, s00 double, s10 double"])
    sums = meet(rows, rows, vector, "__at", fn, schema, by=by, once=True).groupBy(*by).agg(F.sum("s11").alias("s11"), F.sum("s00").alias("s00"), F.sum("s10").alias("s10"))
    sizes = rows.groupBy(*by).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    agg = sums.join(sizes, list(by)) if by else sums.crossJoin(F.broadcast(sizes))  # one row each
    mean = lambda s, n: F.col(s) / F.nullif(n, F.lit(0))
    value = mean("s11", F.col("n1") * (F.col("n1") - 1)) + mean("s00", F.col("n0") * (F.col("n0") - 1)) - 2 * mean("s10", F.col("n1") * F.col("n0"))
    return agg.select(*by, value.alias("mmd2"))


def two_nn_dimension(df: DataFrame, vector: str, key: str, discard: float = 0.1) -> DataFrame:
    """Intrinsic dimension from ratios of the two nearest distances of all rows, the top share discarded, line through 0."""
    from .metrics import ranked

    near = Written(df.sparkSession, "two-nn").keep(knn_all(df, df, vector, key, 2, skip_self=True))
    ratios = near.filter("nearest > 0").select((F.col("kth") / F.col("nearest")).alias("mu"))
    total = ratios.count()
    keep = int(total * (1 - discard))
    kept = ranked(ratios, "mu").filter(F.col("rank") <= keep)
    x, y = F.log("mu"), -F.log(1 - F.col("rank") / (keep + 1))
    return kept.agg((F.sum(x * y) / F.sum(x * x)).alias("dimension"))


def band_pairs(df: DataFrame, key: str, params: Sequence[str], tol: Sequence[float]) -> DataFrame:
    """(a, b): different rows whose parameters differ by at most ``tol`` in every dimension.

    A range join by cells: every parameter is cut into cells of its tolerance
    and a row meets its own and the neighbouring cells only.
    """
    cells = lambda: [F.floor(F.col(p) / e).cast("long") if e else F.col(p) for p, e in zip(params, tol, strict=True)]
    names = [f"c_{p}" for p in params]
    left = df.select(F.col(key).alias("a"), *[c.alias(n) for c, n in zip(cells(), names)], *[F.col(p).alias(f"l_{p}") for p in params])
    right = df.select(F.col(key).alias("b"), *[c.alias(n) for c, n in zip(cells(), names)], *[F.col(p).alias(f"r_{p}") for p in params])
    for n, e in zip(names, tol):
        right = right.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1))) if e else right
    near = F.col("a") != F.col("b")
    for p, e in zip(params, tol, strict=True):
        near = near & (F.abs(F.col(f"l_{p}") - F.col(f"r_{p}")) <= e)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are many times the rows, so neither a broadcast nor the rows' size deals them
    left, right = left.repartition(tasks, *names), right.repartition(tasks, *names)
    return left.join(right.hint("merge"), names).filter(near).select("a", "b")
