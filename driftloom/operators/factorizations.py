"""Factorizations over all rows of a table: tall QR as a tree, and pivoted Cholesky by sweeps.

Only small triangles and the chosen pivots reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Written
from .pairs import Kernel


def _rows(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def tall_qr(df: DataFrame, vector: str, features: Callable[[np.ndarray], np.ndarray] = lambda x: x, fan: int = 8) -> tuple[int, np.ndarray]:
    """(n, R) with ``RᵀR = ΦᵀΦ`` for the features Φ of all rows, the diagonal not negative; Φ and ΦᵀΦ are never formed.

    Each task folds its batches into one triangle; ``fan`` triangles at a time are
    stacked and factored again until one is left.  Rows without a vector are left out.
    """

    def fold(stack: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack(stack), mode="r")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, r = 0, None
        for pdf in batches:
            if len(pdf):
                phi = features(_rows(pdf[vector]))
                n, r = n + len(phi), fold([phi] if r is None else [r, phi])
        if n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "width": [r.shape[1]], "r": [r.ravel().tolist()]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["width"].iloc[0])
        r = fold([np.reshape(x, (-1, width)) for x in pdf.sort_values("from")["r"]])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [int(pdf["n"].sum())], "width": [width], "r": [r.ravel().tolist()]})

    schema, tables = "part long, n long, width long, r array<double>", Written(df.sparkSession, "tall-qr")
    parts = tables.keep(df.select(vector).filter(F.col(vector).isNotNull()).mapInPandas(local, schema))
    while parts.count() > 1:
        nearer = parts.withColumn("from", F.col("part")).withColumn("part", F.floor(F.col("part") / fan))
        parts = tables.keep(nearer.groupBy("part").applyInPandas(join, schema))
        tables.clear(last=1)
    row = parts.first()
    tables.clear()
    if row is None:
        return 0, np.zeros((0, 0))
    r = np.reshape(row["r"], (-1, row["width"]))
    return row["n"], r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


class PivotedFactor(NamedTuple):
    """``K ≈ F Fᵀ`` over all rows: pivots, their own triangle, and the table (key, v, d, f) of residuals and factor rows."""

    keys: list
    points: np.ndarray
    triangle: np.ndarray  # F of the pivots, lower triangular
    table: DataFrame
    sweeps: int


def _extended(f: np.ndarray, k: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Columns that rows with factor ``f`` and kernel values ``k`` get for new pivots whose whole factor rows are ``pivots``."""
    old, out = f.shape[1], np.zeros((len(f), pivots.shape[0]))
    for j, p in enumerate(pivots):
        out[:, j] = (k[:, j] - f @ p[:old] - out[:, :j] @ p[old:old + j]) / p[old + j]
    return out


def pivoted_cholesky_all(df: DataFrame, vector: str, key: str, kernel: Kernel, rank: int, *, eps: float = 0.0, pivot: str = "greedy", seed: int = 0, batch: int = 32, tables: Written | None = None) -> PivotedFactor:
    """Pivoted Cholesky of the Gram matrix of all rows, as the sequential one, several pivots a sweep.

    ``greedy`` takes the greatest residual (ties: the least key).  Residuals only
    fall, so of the ``batch`` greatest of a sweep one may be taken as long as it exceeds
    all that are not among them.  ``rp`` draws by residual: ``batch`` draws from the
    residuals of the sweep, each kept with the chance that its present residual is of
    that one.  ``uniform`` goes by hash order.  It ends at the rank, or once the
    greatest residual is at most ``eps`` or a 10⁻¹⁰ part of the greatest diagonal.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    tables = tables or Written(spark, "pivoted-cholesky")
    schema, rng = f"{key} {kind}, v array<double>, d double, f array<double>", np.random.default_rng(seed)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], "v": pdf["v"], "d": kernel.diag(_rows(pdf["v"])), "f": [[]] * len(pdf)})

    now = tables.keep(df.select(key, F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInPandas(start, schema))
    floor = max(eps, 1e-10 * (now.agg(F.max("d")).first()[0] or 0.0))
    keys, points, triangle, sweeps = [], [], np.zeros((0, 0)), 0
    uniform = lambda *more: (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), *[F.lit(m) for m in more]), 11) + 1) / F.lit(float(1 << 53))
    while len(keys) < rank:
        live = now.filter(F.col("d") > floor)
        bound = -np.inf
        if pivot == "greedy":
            rows = live.orderBy(F.desc("d"), key).limit(batch + 1).collect()
            if len(rows) > batch:
                bound = rows.pop()["d"]
        elif pivot == "rp":
            race = [F.min_by(F.struct(key, "v", "d", "f"), -F.log(uniform(sweeps, b)) / F.col("d")).alias(f"p{b}") for b in range(batch)]
            rows = [r for r in live.agg(*race).first() if r is not None]
        else:
            rows = live.orderBy(uniform(), key).limit(batch).collect()
        if not rows:
            break
        sweeps += 1
        x, stale = np.array([r["v"] for r in rows], dtype=float), np.array([r["d"] for r in rows])
        f, d, chosen = np.array([r["f"] for r in rows], dtype=float).reshape(len(rows), len(keys)), stale.copy(), []
        old, names = len(keys), [r[key] for r in rows]
        order = iter(range(len(rows)))
        while len(keys) < rank:
            if pivot == "greedy":
                i = int(min(range(len(rows)), key=lambda j: (-d[j], names[j])))
                if d[i] <= floor or (chosen and d[i] <= bound):
                    break
            else:
                i = next(order, None)
                if i is None:
                    break
                if d[i] <= floor or (pivot == "rp" and rng.random() * stale[i] >= d[i]):
                    continue
            column = (kernel(x, x[i:i + 1])[:, 0] - f @ f[i]) / np.sqrt(d[i])
            column[i] = np.sqrt(d[i])
            f = np.column_stack((f, column))
            d = np.where([n == names[i] for n in names], 0.0, np.maximum(d - column * column, 0.0))
            chosen.append(i)
            keys.append(names[i])
            points.append(x[i])
        grown = np.zeros((len(keys), len(keys)))
        grown[:old, :old] = triangle
        for j, i in enumerate(chosen):
            grown[old + j, :old + j + 1] = f[i, :old + j + 1]
        triangle = grown
        fresh, tails, taken = x[chosen], triangle[old:], {names[i] for i in chosen}

        def sweep(batches: Iterator[pd.DataFrame], fresh=fresh, tails=tails, taken=taken, old=old) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    f = np.array(pdf["f"].tolist(), dtype=float).reshape(len(pdf), old)
                    more = _extended(f, kernel(_rows(pdf["v"]), fresh), tails)
                    d = np.maximum(pdf["d"].to_numpy() - (more * more).sum(1), 0.0)
                    yield pd.DataFrame({key: pdf[key], "v": pdf["v"], "d": np.where(pdf[key].isin(taken), 0.0, d), "f": list(np.hstack((f, more)))})

        now = tables.keep(now.mapInPandas(sweep, schema))
        tables.clear(last=1)
    return PivotedFactor(keys, np.array(points, dtype=float).reshape(len(keys), len(points[0]) if points else 0), triangle, now, sweeps)
