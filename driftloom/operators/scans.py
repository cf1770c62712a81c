"""First-order recurrences over ordered rows as scans of affine maps.

``y = a * y_before + b`` composes associatively, so a series is cut into blocks that
are scanned apart; the blocks' compositions are a shorter series of the same kind,
and what it gives is what the blocks start from.  No task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4096


def _compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running compositions of the maps ``y -> a y + b``, by doubling."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        a[step:], b[step:] = a[:-step] * a[step:], a[step:] * b[:-step] + b[step:]
        step *= 2
    return a, b


def affine_scan(df: DataFrame, by: Sequence[str], order: str, block: int = BLOCK) -> DataFrame:
    """``df`` (by, order, a, b) with ``y``: ``a * y_before + b`` from 0, in the order of the whole numbers ``order``.

    ``order`` is unique within a series and may have gaps; it also cuts the blocks.
    """
    own = [*by, order, "a", "b"]
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, order))
    cut = df.select(*own).withColumn("__block", F.floor(F.col(order) / block).cast("long"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf["a"], pdf["b"] = _compose(pdf["a"].to_numpy(float), pdf["b"].to_numpy(float))
        return pdf[[*by, order, "__block", "a", "b"]]

    local = cut.groupBy(*by, "__block").applyInPandas(inside, f"{head}, __block long, a double, b double")
    last = cut.agg(F.min("__block"), F.max("__block")).first()
    if last[0] == last[1]:  # also an empty table
        return local.select(*by, order, F.col("b").alias("y"))
    ends = local.groupBy(*by, "__block").agg(F.max_by(F.struct("a", "b"), order).alias("e")).select(*by, F.col("__block").alias("__at"), "e.a", "e.b")
    reached = affine_scan(ends, by, "__at", block)
    # a block starts from what the one before it has reached; a series has one row here for each block
    before = reached.select(*by, F.col("__at").alias("__block"), F.lag("y").over(Window.partitionBy(*by).orderBy("__at")).alias("__from"))
    joined = local.join(before, [*by, "__block"], "left")
    return joined.select(*by, order, (F.col("b") + F.col("a") * F.coalesce("__from", F.lit(0.0))).alias("y"))

