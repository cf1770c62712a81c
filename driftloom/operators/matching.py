"""Matching of episodes and states: nearest joins, forward pairing, per-step pair statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Written
from .pairs import BLOCK_ROWS as CAP
from .pairs import Kernel, mmd2, squared_distances


def _split(x: np.ndarray, size: int) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """k-d cells of about ``size`` of the points: (tree, corners); the outer cells are open."""
    corners: list[tuple[np.ndarray, np.ndarray]] = []

    def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list:
        k = int(np.ptp(x, axis=0).argmax()) if len(x) else 0
        values = np.sort(x[:, k]) if len(x) else x
        if len(x) <= size or values[0] == values[-1]:
            corners.append((low, high))
            return [len(corners) - 1]
        cut = float(min(values[len(x) // 2], values[values < values[-1]][-1]))
        under, over = high.copy(), low.copy()
        under[k] = over[k] = cut
        return [k, cut, grow(x[x[:, k] <= cut], low, under), grow(x[x[:, k] > cut], over, high)]

    return grow(x, np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf)), corners


def _cell(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    under, out = x[:, tree[0]] <= tree[1], np.zeros(len(x), dtype=np.int64)
    out[under], out[~under] = _cell(tree[2], x[under]), _cell(tree[3], x[~under])
    return out


def _nearest_in_cell(rows: DataFrame, points: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, v, match, d2) of each row and the points of its cell; many rows or points of a cell meet in parts."""
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / CAP).alias(name))
    sizes = parts(rows, "lefts").join(parts(points, "rights"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(sizes, "cell").select("cell", F.pmod(F.xxhash64(key), F.col("lefts")).alias("l"), key, "v", every("rights").alias("r"))
    ends = sizes.withColumnRenamed("cell", "of")
    right = points.join(ends, F.col("cell") == F.col("of")).select(F.col("of").alias("cell"), every("lefts").alias("l"), F.pmod(F.xxhash64("match"), F.col("rights")).alias("r"), "match", F.col("v").alias("y"))

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: a[key][:0], "v": a["v"][:0], "match": [], "d2": []})
        b = b.sort_values("match")  # of equally near ones the least
        x, y = (np.array(c.tolist(), dtype=float) for c in (a["v"], b["y"]))
        at, d2 = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for i in range(0, len(x), 256):
            d = sum(np.square(x[i:i + 256, k, None] - y[None, :, k]) for k in range(x.shape[1]))
            at[i:i + 256], d2[i:i + 256] = d.argmin(1), d.min(1)
        return pd.DataFrame({key: a[key], "v": a["v"], "match": b["match"].to_numpy()[at], "d2": d2})

    met = left.groupBy("cell", "l", "r").cogroup(right.groupBy("cell", "l", "r")).applyInPandas(work, f"{key} {kind}, v array<double>, match long, d2 double")
    best = met.groupBy(key).agg(F.min(F.struct("d2", "match")).alias("best"), F.first("v").alias("v"))
    return best.select(key, "v", "best.match", "best.d2")


#: Points by which cells are cut, at most: they bound the cells, whatever the table's size.
SAMPLE = 200_000


def nearest_match(left: DataFrame, right: DataFrame, key: str, params: Sequence[str], n: int = CAP, scale: bool = True) -> DataFrame:
    """(key, match, distance): for each left row (one a key) the nearest of all right rows, parameters standardized by the right (``scale``).

    The right rows are dealt to k-d cells of about ``n``, cut by a sample of at most ``SAMPLE`` points or so, so that
    cells of a very large table hold more and are met in parts.  The nearest in a row's
    own cell bounds its distance; all cells within the bound are searched, so the result is exact.
    """
    moments = right.agg(*[F.avg(p) for p in params], *[F.stddev_pop(p) for p in params]).first()
    k, kind = len(params), dict(left.dtypes)[key]
    moments = moments if scale else [0.0] * k + [1.0] * k
    scaled = lambda df: df.select(key, F.array(*[(F.col(p) - moments[i]) / (moments[k + i] or 1.0) for i, p in enumerate(params)]).alias("v")).filter(~F.exists("v", lambda x: x.isNull()))
    points = scaled(right).groupBy("v").agg(F.min(key).cast("long").alias("match"))  # equal points count once
    total, per_cell = points.count(), 64
    share = min(1.0, per_cell / n, SAMPLE / max(total, 1))
    sample = points.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20))) if total > n else points.limit(0)
    tree, corners = _split(np.array([r["v"] for r in sample.select("v").collect()], dtype=float).reshape(-1, k), per_cell)
    low, high = (np.array(c) for c in zip(*corners, strict=True))

    def own(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=_cell(tree, np.array(pdf["v"].tolist(), dtype=float)))

    def reached(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i:i + 1000]
                x = np.array(part["v"].tolist(), dtype=float)
                d2 = sum(np.square(np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0.0)) for j in range(k))
                row, cell = np.nonzero(d2 <= part["d2"].to_numpy()[:, None])
                yield pd.DataFrame({key: part[key].to_numpy()[row], "v": part["v"].to_numpy()[row], "cell": cell})

    tables = Written(left.sparkSession, "nearest-match")
    points = tables.keep(points.mapInPandas(own, "v array<double>, match long, cell long"))
    bound = _nearest_in_cell(scaled(left).mapInPandas(own, f"{key} {kind}, v array<double>, cell long"), points, key, kind)
    rows = tables.keep(bound.mapInPandas(reached, f"{key} {kind}, v array<double>, cell long"))
    best = _nearest_in_cell(rows, points, key, kind).groupBy(key).agg(F.min(F.struct("d2", "match")).alias("best"))
    return best.select(key, F.col("best.match").alias("match"), F.sqrt("best.d2").alias("distance"))


#: Where bands meet: episodes that make a part of their own and parts that a cell's side is cut into while they hold no more
#: than ``HELD_EPISODES``; states of a part; and candidates that a state is held against at once, at most.
BAND_ROWS, BAND_SIDE, HELD_EPISODES, HELD_STATES, CANDIDATES = 500, 8, 1 << 16, 1 << 19, 512


def _meet_bands(left: DataFrame, right: DataFrame, key: str, cells: Sequence[Column], reach: Sequence[Sequence[int]], fn, schema: str, side: int, held: int) -> DataFrame:
    """Union of ``fn(a, b)`` over cells: a's left rows lie in the cell, b's right rows in one that is ``reach`` away (a list a dimension).

    The rows of a cell meet in parts by hash of ``key``.  Copies of a row are as many as the other side's parts: at most ``side`` until
    a part would hold more than ``held`` rows.
    """
    names = [f"__c{i}" for i in range(len(cells))]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # a table may meet itself
    left, right = (df.select("*", *[c.alias(n) for c, n in zip(cells, names)]) for df in (left, right))
    for n, steps in zip(names, reach, strict=True):
        right = right.withColumn(n, F.explode(F.array(*[F.col(n) - k for k in steps])))
    parts = lambda df, name: df.groupBy(*names).agg(F.greatest(F.least(F.ceil(F.count("*") / BAND_ROWS), F.lit(side)), F.ceil(F.count("*") / held)).alias(name))
    sizes = parts(left, "lefts").join(parts(right, "rights"), names)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(key), F.col(n))
    a = left.join(sizes, names).select(*left.columns, own("lefts").alias("__l"), every("rights").alias("__r"))
    ends = sizes.select(*[F.col(n).alias(f"{n}_of") for n in names], "lefts", "rights")
    b = right.join(ends, [F.col(n) == F.col(f"{n}_of") for n in names]).select(*[c for c in right.columns if c not in names], *[F.col(f"{n}_of").alias(n) for n in names], own("rights").alias("__r"), every("lefts").alias("__l"))

    def work(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return fn(p, q) if len(p) and len(q) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return a.groupBy(*names, "__l", "__r").cogroup(b.groupBy(*names, "__l", "__r")).applyInPandas(work, schema)


def forward_divergence(states: DataFrame, episodes: DataFrame, channel: str, params: Sequence[str], tol: Sequence[float], start: int, steps: int) -> DataFrame:
    """(s, mean_log): mean log distance ``s`` steps on of episode pairs with close parameters, from step ``start``.

    Episodes, each with its states as an array, meet in cells of the first parameter; a
    task adds up its pairs, so that none is laid out.
    """
    part = states.filter((F.col("t") >= start) & (F.col("t") < start + steps) & F.col(channel).isNotNull())
    runs = part.groupBy("ep").agg(F.map_from_entries(F.collect_list(F.struct((F.col("t") - start).cast("int").alias("s"), F.col(channel).cast("double")))).alias("m"))  # ``steps`` entries
    known = episodes.select("ep", *[F.col(p).cast("double").alias(f"__p{i}") for i, p in enumerate(params)]).dropna()
    rows = known.join(runs, "ep").select("*", F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: F.try_element_at("m", s)).alias("x")).drop("m")
    rows = Written(states.sparkSession, "divergence").keep(rows)
    order = [f"__p{i}" for i in range(len(params))]

    def fn(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        q = q.sort_values(["__p0", "ep"], kind="stable")
        x, y = (np.array([np.asarray(r, dtype=float) for r in f["x"]]) for f in (p, q))
        u, v = p[order].to_numpy(float), q[order].to_numpy(float)
        ids, others = p["ep"].to_numpy(), q["ep"].to_numpy()
        first, last = np.searchsorted(v[:, 0], u[:, 0]), np.searchsorted(v[:, 0], u[:, 0] + tol[0] * (1 + 1e-9) + 1e-12 * np.abs(u[:, 0]), side="right")
        total, n = np.zeros(steps), np.zeros(steps, dtype=np.int64)
        for i in range(len(p)):
            lo, hi = first[i], last[i]
            while lo < hi and v[lo, 0] == u[i, 0] and others[lo] <= ids[i]:  # of a pair the one with the lesser (parameter, ep) comes first
                lo += 1
            for at in range(lo, hi, 4096):
                end = min(at + 4096, hi)
                near = (np.abs(v[at:end] - u[i]) <= tol).all(1)
                d = np.abs((y[at:end] if near.all() else y[at:end][near]) - x[i])
                ok = d > 0
                n += ok.sum(0)
                total += np.log(np.where(ok, d, 1.0)).sum(0)
        return pd.DataFrame({"s": np.arange(steps), "total": total, "n": n})[n > 0]

    cell = F.floor(F.col("__p0") / tol[0]).cast("long") if tol[0] else F.col("__p0")
    sums = _meet_bands(rows, rows, "ep", [cell], [(0, 1) if tol[0] else (0,)], fn, "s long, total double, n long", BAND_SIDE, HELD_EPISODES)
    return sums.groupBy("s").agg((F.sum("total") / F.sum("n")).alias("mean_log"), F.sum("n").alias("n"))


def matched_neighbours(states: DataFrame, episodes: DataFrame, channels: Sequence[str], params: Sequence[str], tol: Sequence[float], window: int, start: int, steps: int, anchors: int | None = None, seed: int = 0) -> DataFrame:
    """(ep, t, match, match_t, d2): for each state the nearest one of another episode with close parameters and close in time.

    States meet by cells of time and of the first parameter; there a state goes through
    the others by the first channel, outwards from its own value, until none can be
    nearer.  Parameters are within ``tol``, ``|t - match_t| <= window``; both lie at ``start``
    at the earliest and have ``steps`` more steps.  Of equally near ones, to 12 digits, the least
    (match, match_t) is taken; states without any are left out.  ``anchors`` takes that many states in hash order.
    """
    names, order = [f"__x{i}" for i in range(len(channels))], [f"__p{i}" for i in range(len(params))]
    known = episodes.select("ep", "n_steps", *[F.col(p).cast("double").alias(n) for p, n in zip(params, order)]).dropna(subset=order)
    usable = states.dropna(subset=list(channels)).join(known, "ep").filter((F.col("t") >= start) & (F.col("t") + steps < F.col("n_steps")))
    usable = Written(states.sparkSession, "matched").keep(usable.select("ep", F.col("t").cast("long").alias("t"), *order, *[F.col(c).cast("double").alias(n) for c, n in zip(channels, names)]))
    asked = usable if anchors is None else usable.orderBy(F.xxhash64("ep", "t", F.lit(seed)), "ep", "t").limit(anchors)
    kind = dict(usable.dtypes)["ep"]

    def fn(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        q = q.sort_values(["ep", "t"])
        q = q.assign(rank=np.arange(len(q))).sort_values(names[0], kind="stable")
        codes = pd.factorize(np.concatenate((p["ep"].to_numpy(), q["ep"].to_numpy())))[0]
        x, y, u, v = p[names].to_numpy(float), q[names].to_numpy(float), p[order].to_numpy(float), q[order].to_numpy(float)
        me, other, t, w, rank = codes[:len(p)], codes[len(p):], p["t"].to_numpy(), q["t"].to_numpy(), q["rank"].to_numpy()
        best, which = np.full(len(p), np.inf), np.full(len(p), len(q))
        rounded = lambda d2: np.floor(d2 * 1e12 + 0.5) / 1e12
        middle = np.searchsorted(y[:, 0], x[:, 0])
        for up in (True, False):
            active, at, width = np.arange(len(p)), middle.copy(), 16
            while True:
                active = active[at[active] < len(q)] if up else active[at[active] > 0]
                if len(active):  # the next one must still be able to be as near
                    edge = at[active] if up else at[active] - 1
                    active = active[rounded(np.square(y[edge, 0] - x[active, 0])) <= best[active]]
                if not len(active):
                    break
                for some in np.array_split(active, -(-len(active) * width // (1 << 18))):
                    cand = at[some][:, None] + (np.arange(width) if up else -1 - np.arange(width))
                    inside = (cand >= 0) & (cand < len(q))
                    cand = np.clip(cand, 0, len(q) - 1)
                    ok = inside & (other[cand] != me[some][:, None]) & (np.abs(w[cand] - t[some][:, None]) <= window)
                    for k in range(len(params)):
                        ok &= np.abs(v[cand, k] - u[some, k][:, None]) <= tol[k]
                    d2 = np.where(ok, rounded(sum(np.square(y[cand, k] - x[some, k][:, None]) for k in range(len(names)))), np.inf)
                    least = d2.min(1)
                    first = np.where(ok & (d2 == least[:, None]), rank[cand], len(q)).min(1)
                    better = (least < best[some]) | ((least == best[some]) & (first < which[some]))
                    best[some[better]], which[some[better]] = least[better], first[better]
                at[active] += width if up else -width
                width = min(2 * width, CANDIDATES)
        found, back = np.isfinite(best), np.argsort(rank)
        match = q.iloc[back[which[found]]]
        return pd.DataFrame({"ep": p["ep"].to_numpy()[found], "t": t[found], "match": match["ep"].to_numpy(), "match_t": match["t"].to_numpy(), "d2": best[found]})

    cells = [F.floor(F.col("t") / (window + 1)).cast("long"), F.floor(F.col("__p0") / tol[0]).cast("long") if tol[0] else F.col("__p0")]
    met = _meet_bands(asked, usable, "ep", cells, [(-1, 0, 1), (-1, 0, 1) if tol[0] else (0,)], fn, f"ep {kind}, t long, match {kind}, match_t long, d2 double", 1, HELD_STATES)
    best = met.groupBy("ep", "t").agg(F.min(F.struct("d2", "match", "match_t")).alias("n"))
    return best.select("ep", "t", "n.match", "n.match_t", "n.d2")


def nearest_in_cells(df: DataFrame, fitted: DataFrame, vector: str, key: str, k: int) -> DataFrame:
    """(key, score, kth, nearest) of each row among all ``fitted`` rows, as ``pairs.knn_all`` gives them, for vectors of few dimensions.

    Fitted rows are dealt to k-d cells; the k nearest in a row's own cell bound the
    others, and only cells within the bound are searched, so the result is exact.
    """
    kind = dict(df.dtypes)[key]
    rows = lambda t: t.select(F.xxhash64(key).alias("id"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    tables, per_cell = Written(df.sparkSession, "nearest"), 64
    points = rows(fitted).select("id", "v")
    total = points.count()
    share = min(1.0, per_cell / CAP, SAMPLE / max(total, 1))
    sample = points.filter(F.pmod("id", F.lit(1 << 20)) < int(share * (1 << 20))) if total > CAP else points.limit(0)
    drawn = [r["v"] for r in sample.select("v").collect()]  # SAMPLE rows or so
    first = points.select(F.size("v")).first()
    width = first[0] if first else 1
    tree, corners = _split(np.array(drawn, dtype=float).reshape(-1, width), per_cell)
    low, high = (np.array(c) for c in zip(*corners, strict=True))

    def own(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=_cell(tree, np.array(pdf["v"].tolist(), dtype=float)))

    def reached(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i:i + 1000]
                x = np.array(part["v"].tolist(), dtype=float)
                d2 = sum(np.square(np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0.0)) for j in range(width))
                near = d2 < part["bound"].to_numpy()[:, None]
                near[np.arange(len(part)), part["cell"].to_numpy()] = False
                row, cell = np.nonzero(near)
                yield part.iloc[row].assign(cell=cell)

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(c.tolist(), dtype=float) for c in (a["v"], b["v"]))
        bound, near, some = a["bound"].to_numpy(float), [], []
        for i in range(0, len(x), 256):
            best = np.full((len(x[i:i + 256]), k), np.inf)
            for j in range(0, len(y), 4096):
                d2 = sum(np.square(x[i:i + 256, c, None] - y[None, j:j + 4096, c]) for c in range(width))
                rows = np.flatnonzero(d2.min(1) < np.minimum(best[:, -1], bound[i:i + 256]))
                part = np.partition(d2[rows], min(k, d2.shape[1]) - 1, axis=1)[:, :k]
                best[rows] = np.sort(np.concatenate((best[rows], part), axis=1), axis=1)[:, :k]
            found = np.isfinite(best[:, 0])
            near.extend(best[found])
            some.append(i + np.flatnonzero(found))
        return a.iloc[np.concatenate(some)][["id", "key", "v", "cell"]].assign(near=near)

    head = f"id long, key {kind}, v array<double>, cell long"
    points = tables.keep(points.mapInPandas(own, "id long, v array<double>, cell long"))
    asked = rows(df).mapInPandas(own, head).withColumn("bound", F.lit(float("inf")))
    least = lambda t: F.slice(F.array_sort(F.filter(F.flatten(F.collect_list(t)), lambda d: d < float("inf"))), 1, k)  # noqa: E731  k a part of a cell
    meet = lambda left: _meet_bands(left, points, "id", [F.col("cell")], [(0,)], search, f"{head}, near array<double>", 1, HELD_EPISODES)
    held = meet(asked).groupBy("key").agg(F.first("id").alias("id"), F.first("v").alias("v"), F.first("cell").alias("cell"), least("near").alias("near"))
    held = tables.keep(held.withColumn("bound", F.coalesce(F.try_element_at("near", F.lit(k)), F.lit(float("inf")))))
    more = meet(held.drop("near").select("id", "key", "v", "cell", "bound").mapInPandas(reached, f"{head}, bound double"))
    best = held.select("key", "near").unionByName(more.select("key", "near")).groupBy("key").agg(F.transform(least("near"), lambda d: F.sqrt(d)).alias("d"))
    return best.select(F.col("key").alias(key), (F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / F.size("d")).alias("score"), F.try_element_at("d", F.lit(-1)).alias("kth"), F.try_element_at("d", F.lit(1)).alias("nearest"))


def matched_curves(states: DataFrame, neighbours: DataFrame, channels: Sequence[str], steps: int, least: float = 1e-12) -> DataFrame:
    """(a, b, s, log_d): log distance of each state and its neighbour, ``s`` = 0 .. ``steps`` steps on; ``a`` names the state."""
    vector = F.array(*[F.col(c).cast("double") for c in channels])
    ahead = neighbours.select("ep", "t", "match", "match_t", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("s"))
    x = states.select("ep", F.col("t").alias("__t"), vector.alias("x"))
    y = states.select(F.col("ep").alias("match"), F.col("t").alias("__u"), vector.alias("y"))
    both = ahead.withColumns({"__t": F.col("t") + F.col("s"), "__u": F.col("match_t") + F.col("s")}).join(x, ["ep", "__t"]).join(y, ["match", "__u"])
    gap = F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, v: t + v)
    return both.select(F.concat_ws(":", "ep", "t").alias("a"), F.col("match").alias("b"), "s", F.log(F.sqrt(gap) + least).alias("log_d"))


def matched_divergence(states: DataFrame, episodes: DataFrame, channels: Sequence[str], params: Sequence[str], *, share: float = 0.1, window: int = 5, start: int = 100, steps: int = 50, skip: int = 2, anchors: int | None = 1000, replicates: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(curve, slope) of the divergence of matched states: (s, mean_log, n) and (slope, low, high) from step ``skip`` on.

    Channels are standardized over all states; parameters match within ``share`` of their
    range (1 where that is 0).  The interval is a Poisson bootstrap over states.
    """
    moments = states.agg(*[F.avg(c) for c in channels], *[F.stddev_pop(c) for c in channels]).first()
    k = len(channels)
    scaled = states.select("ep", "t", *[((F.col(c) - moments[i]) / (moments[k + i] or 1.0)).alias(c) for i, c in enumerate(channels)])
    spans = episodes.agg(*[F.max(p) - F.min(p) for p in params]).first()
    near = matched_neighbours(scaled, episodes, channels, params, [share * float(v or 1.0) for v in spans], window, start, steps, anchors, seed)
    curves = matched_curves(scaled, near, channels, steps)
    return curves.groupBy("s").agg(F.avg("log_d").alias("mean_log"), F.count("*").alias("n")), slope_interval(curves.filter(F.col("s") >= skip), replicates, seed)


def slope_interval(curves: DataFrame, replicates: int = 200, seed: int = 0, share: float = 0.9) -> DataFrame:
    """(slope, low, high): slope of mean log distance over steps, with a bootstrap interval over pairs.

    ``curves`` has (a, b, s, log_d).  A pair's weight in a replicate is a Poisson draw
    by hash, so replicates are sums of one pass and no resample is laid out.
    """
    u = lambda r: (F.shiftrightunsigned(F.xxhash64("a", "b", F.lit(seed), r), 11) + 1) / F.lit(float(1 << 53))
    edges = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(8)])
    weight = lambda v: sum((v > float(e)).cast("int") for e in edges)
    many = curves.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", F.when(F.col("r") == 0, 1).otherwise(weight(u(F.col("r")))))
    steps = many.groupBy("r", "s").agg((F.sum(F.col("w") * F.col("log_d")) / F.sum("w")).alias("m"))
    slopes = steps.groupBy("r").agg(F.regr_slope("m", "s").alias("slope"))
    tail = (1 - share) / 2
    spread = F.percentile(F.when(F.col("r") > 0, F.col("slope")), [tail, 1 - tail])
    return slopes.agg(F.max(F.when(F.col("r") == 0, F.col("slope"))).alias("slope"), spread.alias("p")).select("slope", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def divergence_slope(curve: DataFrame) -> DataFrame:
    return curve.agg(F.regr_slope("mean_log", "s").alias("slope"))


def per_step_gram(states: DataFrame, channels: Sequence[str], kernel: Kernel, n: int = 200) -> DataFrame:
    """(t, i, j, k, k_i, k_j): kernel values of every episode i against reference episodes j at the same step, and of each with itself.

    ``n`` bounds the reference set, the first episodes in shuffled order; states with
    a missing channel are left out.
    """
    from .episodes import subsample

    whole = states.dropna(subset=list(channels)).select("ep", "t", F.array(*[F.col(c).cast("double") for c in channels]).alias("x"))
    refs = whole.join(subsample(states.select("ep").distinct(), n), "ep", "left_semi")
    refs = refs.groupBy("t").agg(F.array_sort(F.collect_list(F.struct(F.col("ep").alias("j"), F.col("x").alias("y")))).alias("refs"))  # n entries a step

    def work(batches):
        for pdf in batches:
            for t, part in pdf.groupby("t"):
                x, j = np.array(part["x"].tolist(), dtype=float), part["refs"].iloc[0]
                y = np.array([r["y"] for r in j], dtype=float)
                yield pd.DataFrame({"t": t, "i": np.repeat(part["ep"].to_numpy(), len(y)), "j": np.tile([r["j"] for r in j], len(x)),
                                    "k": kernel(x, y).ravel(), "k_i": np.repeat(kernel.diag(x), len(y)), "k_j": np.tile(kernel.diag(y), len(x))})

    return whole.join(refs, "t").mapInPandas(work, "t long, i long, j long, k double, k_i double, k_j double")


def mmd_per_step(states: DataFrame, channels: Sequence[str], kernel: Kernel, label: Column) -> DataFrame:
    """(t, mmd2): unbiased squared MMD at each step between all episodes where ``label`` holds and all others."""
    whole = states.dropna(subset=list(channels)).withColumn("__x", F.array(*[F.col(c).cast("double") for c in channels]))
    return mmd2(whole, "__x", "ep", label, kernel, by=["t"])


def kernel_distance(gram: DataFrame) -> DataFrame:
    """(t, i, j, d): distance in feature space."""
    return gram.select("t", "i", "j", F.sqrt(F.greatest(F.col("k_i") + F.col("k_j") - 2 * F.col("k"), F.lit(0.0))).alias("d"))


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Hausdorff distance of two finite sets of points."""
    d = np.sqrt(squared_distances(a, b))
    return float(max(d.min(1).max(), d.min(0).max()))


def level_set_distance(grid: DataFrame, channels: Sequence[str], score_a: str, level_a: float, score_b: str, level_b: float) -> tuple[float | None, float]:
    """(Hausdorff distance, share of b's points outside a) of the accepted parts of a grid under two scores.

    Nearest points are searched in cells, so the grid may be of any size; the
    distance is null if a part is empty.
    """
    tables = Written(grid.sparkSession, "level-sets")
    marked = tables.keep(grid.withColumn("__id", F.monotonically_increasing_id()).select("__id", *channels, (F.col(score_a) <= level_a).alias("__in_a"), (F.col(score_b) <= level_b).alias("__in_b")))
    a, b = marked.filter("__in_a"), marked.filter("__in_b")
    n_a, n_b, out = marked.agg(F.sum(F.col("__in_a").cast("int")), F.sum(F.col("__in_b").cast("int")), F.sum((F.col("__in_b") & ~F.col("__in_a")).cast("int"))).first()
    far = lambda p, q: nearest_match(p, q, "__id", channels, scale=False).agg(F.max("distance")).first()[0]
    distance = max(far(a, b), far(b, a)) if n_a and n_b else None
    tables.clear()
    return distance, (out or 0) / max(n_b or 0, 1)
