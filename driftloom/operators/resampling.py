"""Permutation tests, balanced subsamples and the bootstrap over all rows of a table.

A replicate is a rule by hash, so that none is laid out: a permutation or a subsample
is the rows whose hash lies below a threshold, found exactly; a bootstrap weight is a
Poisson draw.  Replicates share one pass: their members are the columns of a matrix
that each block of kernel values, or slice of scores, is multiplied by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import slices
from .pairs import Kernel, meet, tiles

#: Leading bits of a hash by which rows are counted before the threshold's own few are ranked.
HEAD_BITS = 12


def _hash(key: str, seed: int, replicate: Column) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed), replicate)


def hash_thresholds(df: DataFrame, key: str, group: str, take: dict[int, int], replicates: int, seed: int) -> dict[int, list[int]]:
    """For each group and replicate the hash up to which exactly ``take[group]`` of its rows lie (keys are unique).

    Counts by leading bits tell where that is, a window ranks the rows that share
    those bits; one number a group and replicate reaches the driver.
    """
    spark = df.sparkSession
    wanted = spark.createDataFrame([(g, n) for g, n in take.items()], "g int, n long")
    hashed = df.select(F.col(group).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"), key).withColumn("h", _hash(key, seed, F.col("r")))
    hashed = hashed.select("g", "r", "h", F.shiftright("h", 64 - HEAD_BITS).alias("head"))
    counts = hashed.groupBy("g", "r", "head").agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy("g", "r").orderBy("head"))  # 2**HEAD_BITS rows
    reached = counts.withColumn("upto", run).join(F.broadcast(wanted), "g").filter((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("c") < F.col("n")))
    reached = reached.select("g", "r", "head", (F.col("n") - F.col("upto") + F.col("c")).alias("rank"))  # one row a group and replicate
    inside = hashed.join(F.broadcast(reached), ["g", "r", "head"]).withColumn("i", F.row_number().over(Window.partitionBy("g", "r").orderBy("h")))
    out: dict[int, list[int]] = {g: [np.iinfo(np.int64).min] * replicates for g in take}
    for row in inside.filter("i = rank").select("g", "r", "h").collect():
        out[row["g"]][row["r"]] = row["h"]
    return out


def _members(key: str, seed: int, limits: list[int]) -> Column:
    """0 or 1 for each replicate, as bytes."""
    names = F.array(*[F.lit(int(x)) for x in limits]).cast("array<long>")
    return F.transform(names, lambda limit, r: (_hash(key, seed, r) <= limit).cast("tinyint"))


def kernel_sums(rows: DataFrame, vector: str, key: str, kernel: Kernel) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(s11, s00, s10) of each permutation and of each subsample: sums of the kernel over pairs of ones, of zeros, and of one each.

    ``rows`` has the label ``__y`` and arrays of 0 and 1, a place a replicate: ``u``, the ones of
    a permutation, and ``t``, the members of a subsample, who keep their label.  A row and itself are no pair.  A pair's
    value is made once for all replicates, and what a permutation's zeros add follows from its ones and the sums of the rows.
    """
    matrix = lambda pdf: np.hstack([np.array(pdf[c].tolist(), dtype=np.int8).reshape(len(pdf), -1) for c in ("u", "t")])

    def fn(p: pd.DataFrame, x: np.ndarray, q: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        both, ids, others, n = p["__l"].iloc[0] != q["__r"].iloc[0], p[key].to_numpy(), q[key].to_numpy(), len(p["u"].iloc[0])
        m, w, labels, against = matrix(p), matrix(q), p["__y"].to_numpy(), q["__y"].to_numpy()
        down, across, sums = np.zeros(len(p)), np.zeros(len(q)), np.zeros((2, 2, m.shape[1]))
        for left in (0, 1):
            for right in (0, 1):
                mine, theirs = np.flatnonzero(labels == left), np.flatnonzero(against == right)
                for i, j in tiles(len(mine), len(theirs)):
                    i, j = mine[i], theirs[j]
                    g = kernel(x[i], y[j])
                    if not both and left == right:
                        g[ids[i, None] == others[None, j]] = 0.0
                    down[i] += g.sum(1)
                    across[j] += g.sum(0)
                    sums[left, right] += (m[i] * (g @ w[j].astype(float))).sum(0)
        ones, total = down @ m[:, :n], down.sum()
        if both:  # the pairs of two blocks in both orders
            sums, ones, total = sums + sums.transpose(1, 0, 2), ones + across @ w[:, :n], 2 * total
        s11, drawn = sums[:, :, :n].sum((0, 1)), sums[:, :, n:]
        out = {"s11": np.append(s11, drawn[1, 1]), "s00": np.append(total - 2 * ones + s11, drawn[0, 0]), "s10": np.append(ones - s11, drawn[1, 0])}
        return pd.DataFrame({"r": np.arange(m.shape[1]), "n": n, **out})

    sums = meet(rows, rows, vector, key, fn, "r long, n long, s11 double, s00 double, s10 double", once=True)
    found = sums.groupBy("r", "n").agg(F.sum("s11").alias("s11"), F.sum("s00").alias("s00"), F.sum("s10").alias("s10")).toPandas().sort_values("r")  # a row a replicate
    return found[found["r"] < found["n"]], found[found["r"] >= found["n"]]


def _mmd2(sums: pd.DataFrame, ones: int, zeros: int) -> np.ndarray:
    return (sums["s11"] / (ones * (ones - 1)) + sums["s00"] / (zeros * (zeros - 1)) - 2 * sums["s10"] / (ones * zeros)).to_numpy()


def _labelled(df: DataFrame, vector: str, key: str, label: Column) -> tuple[DataFrame, int, int]:
    rows = df.select(key, F.col(vector), label.cast("int").alias("__y")).filter(F.col("__y").isNotNull() & F.col(vector).isNotNull())
    n = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    return rows, n.get(1, 0), n.get(0, 0)


def mmd_permutation(df: DataFrame, vector: str, key: str, label: Column, kernel: Kernel, permutations: int = 200, seed: int = 0) -> DataFrame:
    """(mmd2, null_mean, null_sd, z) of all rows against permuted labels; ``key`` is unique.

    Each permutation keeps the number of ones.  Null if a label has fewer than two rows.
    """
    return _tested(df, vector, key, label, kernel, permutations, seed, 0.0)[0]


TEST = "mmd2 double, null_mean double, null_sd double, z double"


def _tested(df: DataFrame, vector: str, key: str, label: Column, kernel: Kernel, replicates: int, seed: int, share: float) -> tuple[DataFrame, np.ndarray]:
    """The permutation test, and the values of subsamples of a share of the smaller label; none without a share, or of fewer than two rows."""
    spark = df.sparkSession
    rows, ones, zeros = _labelled(df, vector, key, label)
    if min(ones, zeros) < 2:
        return spark.createDataFrame([(None,) * 4], TEST), np.zeros(0)
    limits = hash_thresholds(rows.withColumn("__all", F.lit(0)), key, "__all", {0: ones}, replicates, seed)[0]
    u = F.concat(F.array(F.col("__y").cast("tinyint")), _members(key, seed, limits))  # the labels themselves come first
    t, k = F.array().cast("array<tinyint>"), min(max(30, int(share * min(ones, zeros))), ones, zeros)
    if share:
        limits = hash_thresholds(rows, key, "__y", {1: k, 0: k}, replicates, seed + 1)
        t = F.when(F.col("__y") == 1, _members(key, seed + 1, limits[1])).otherwise(_members(key, seed + 1, limits[0]))
    permuted, drawn = kernel_sums(rows.select(key, vector, "__y", u.alias("u"), t.alias("t")), vector, key, kernel)
    value = _mmd2(permuted, ones, zeros)
    mean, sd = float(value[1:].mean()), float(value[1:].std())
    return spark.createDataFrame([(float(value[0]), mean, sd, float((value[0] - mean) / sd) if sd else None)], TEST), _mmd2(drawn, k, k)


def mmd_interval(df: DataFrame, vector: str, key: str, label: Column, kernel: Kernel, replicates: int = 200, seed: int = 0, share: float = 0.8) -> DataFrame:
    """The permutation test with the 5th and 95th percentile of its z over class-balanced subsamples of all rows."""
    test, drawn = _tested(df, vector, key, label, kernel, replicates, seed, share)
    if not len(drawn):
        return test.select("mmd2", "z", F.lit(None).cast("double").alias("z_low"), F.lit(None).cast("double").alias("z_high"))
    low, high = np.quantile(drawn, [0.05, 0.95])
    z = lambda v: (F.lit(float(v)) - F.col("null_mean")) / F.col("null_sd")
    return test.select("mmd2", "z", z(low).alias("z_low"), z(high).alias("z_high"))


def bootstrap_auroc(df: DataFrame, label: str = "label", score: str = "score", replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(estimate, se, replicates): AUROC of all rows and its deviation over resamples; those of one class are skipped.

    Rows count once for each distinct score, and a resample gives the count of a score and
    label a Poisson draw of that mean.  Slices of the order are summed in one sweep each,
    with what lies below in the slice; what lies below the slice comes from the slices' sums.
    """
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n"))
    cut = slices(counts, "s").repartition("__slice").sortWithinPartitions("__slice", "s")

    def close(number: int, sums: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"slice": [number], **{c: [x.tolist()] for c, x in zip(("p", "n", "u"), sums)}})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = None, []
        for pdf in batches:
            for number, part in pdf.groupby("__slice", sort=False):
                if number != now:
                    if now is not None:
                        yield close(now, sums)
                    now, sums = number, [np.zeros(replicates + 1) for _ in range(3)]
                for s, p, n in zip(part["s"].to_numpy() + 0.0, part["p"].to_numpy(), part["n"].to_numpy()):
                    rng = np.random.default_rng([seed, int(np.float64(s).view(np.uint64))])  # by the score, so a task can run again
                    mine, others = (np.concatenate(([k], rng.poisson(k, replicates))) for k in (p, n))
                    sums[2] += mine * (sums[1] + others / 2)
                    sums[0] += mine
                    sums[1] += others
        if now is not None:
            yield close(now, sums)

    long = cut.select("__slice", "s", "p", "n").mapInPandas(work, "slice long, p array<double>, n array<double>, u array<double>")
    each = long.select("slice", F.posexplode(F.arrays_zip("p", "n", "u")).alias("r", "x")).select("slice", "r", "x.*")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # some hundred slices
    value = each.withColumn("u", F.col("u") + F.col("p") * below).groupBy("r").agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")).alias("v"))
    drawn = F.when(F.col("r") > 0, F.col("v"))
    return value.agg(F.max(F.when(F.col("r") == 0, F.col("v"))).alias("estimate"), F.stddev_pop(drawn).alias("se"), F.count(drawn).alias("replicates"))
