"""Mixing to target weights by iterative proportional fitting (DataFrame only).

Tokens are summed per (source, language, topic) cell.  Cell weights are raked to
the three target marginals in turn until they hold; the ratio of a cell's weight
to its tokens is, up to one factor, the probability with which its documents are
drawn.  A document is in the sample if a seeded hash of its id lies below it.

The cells live in a table, never on the driver: a step is one pre-aggregated sum
per marginal value and a join, and each round is written to the shared folder.

Null sources, languages and topics are values of their own.  Empty texts have no
token.  Repeated rows share their id's draw.  Very long texts count with all their
tokens.  Columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch

MARGINALS = ("source", "lang", "topic")
#: Target share of a value: its share of tokens to this power, renormalised.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Rounds of raking at most, and the greatest miss of a marginal's share at which they end.
ROUNDS, TOLERANCE = 200, 1e-6
#: Cells up to which their table is broadcast (about 100 bytes each).
BROADCAST_CELLS = 500_000
#: Tokens that the sample is expected to hold, as a share of all.
KEEP = 0.7


def topic_of(text: Column) -> Column:
    """Layout of a text as its topic: table, marked, listing, short or prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    marks = n - F.length(F.translate(t, "#*$%&", ""))
    bars = n - F.length(F.replace(t, F.lit("|"), F.lit("")))
    breaks = n - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (F.when(bars * 40 > n, "table").when(marks * 20 > n, "marked").when(breaks * 60 > n, "listing")
            .when(n < 400, "short").otherwise("prose"))


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def targets(cells: DataFrame, temper: dict[str, float] = TEMPER) -> dict[str, DataFrame]:
    """For each marginal a table (value, ``__t``) of shares that sum to 1."""
    out = {}
    for name in MARGINALS:
        sums = cells.groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper[name])).alias("__t"))
        out[name] = sums.crossJoin(sums.agg(F.sum("__t").alias("__all"))).select(name, (F.col("__t") / F.col("__all")).alias("__t"))  # one row on the right
    return out


def rake(cells: DataFrame, goal: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """Cells with ``weight`` (sum 1) raked to ``goal``, and the greatest miss of a marginal.

    A value without a target keeps its weight; a cell without tokens stays 0.
    Targets that contradict the empty cells can't be met: the last round's weights
    count then, with a warning that names the miss.
    """
    tables = Scratch(cells.sparkSession, "rake")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = [f"__t_{name}" for name in MARGINALS]
    for name, to in goal.items():  # a cell keeps its targets, so a round joins nothing but its sums
        cells = cells.join(tables.keep(to.withColumnRenamed("__t", f"__t_{name}"), name), name, "left")
    table, miss = tables.keep(cells.withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1)))), "start"), 0.0
    for i in range(rounds):
        for name in MARGINALS:
            to = F.coalesce(f"__t_{name}", "__w")
            table = (table.join(table.groupBy(name).agg(F.sum("weight").alias("__w")), name)
                     .withColumn(f"__gap_{name}", F.abs(F.col("__w") - to))
                     .withColumn("weight", F.when(F.col("__w") > 0, F.col("weight") * to / F.col("__w")).otherwise(0.0))
                     .drop("__w"))
        seen = Observation()
        gap = F.greatest(*[f"__gap_{x}" for x in MARGINALS])
        table = tables.keep(table.observe(seen, F.max(gap).alias("miss")).drop(*[f"__gap_{x}" for x in MARGINALS]), f"round{i}")
        tables.drop(f"round{i - 1}")
        miss = seen.get["miss"] or 0.0
        if miss < tolerance:
            break
    else:
        if rounds:
            warnings.warn(f"raking misses a marginal by {miss:.3g} after {rounds} rounds", stacklevel=2)
    return table.drop(*goals), miss


def rate_scale(table: DataFrame, keep: float = KEEP) -> float:
    """Factor s for which ``sum(tokens * min(1, s * rate))`` is ``keep`` of all tokens.

    The sum is found for a grid of factors in one aggregate; the grid closes in on
    the factor to ten digits.
    """
    has = F.col("rate") > 0
    total, slope, least = table.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("rate")), F.min(F.when(has, F.col("rate")))).first()
    if not total or not slope:
        return 0.0
    if keep >= 1:
        return math.inf
    lo, hi, grid = keep * total / slope, 1 / least, 48
    for _ in range(8):
        if hi <= lo * (1 + 1e-10):
            break
        at = [lo * (hi / lo) ** (i / grid) for i in range(1, grid)]
        held = table.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * F.col("rate"))) for s in at]).first()
        under = sum(h < keep * total for h in held)
        edges = [lo, *at, hi]
        lo, hi = edges[under], edges[under + 1]
    return (lo + hi) / 2


def mix(docs: DataFrame, *, topic: Column | None = None, temper: dict[str, float] = TEMPER, keep: float = KEEP, seed: int = 23) -> DataFrame:
    """Adds ``topic``, ``n_tokens``, ``weight``, ``probability`` and ``selected`` to every row of ``docs``.

    A null source, language or topic is a value of its own.  An empty text has no
    token, probability 1 if its cell has no token at all, else its cell's.  Repeated
    rows share their id's draw.  An input column of these names is replaced.  An empty table gives an empty result.  The text is
    read once and left out of the result; ``draw`` returns whole rows.
    """
    return _mix(docs, "text" in docs.columns, topic, temper, keep, seed)


def draw(docs: DataFrame, *, topic: Column | None = None, temper: dict[str, float] = TEMPER, keep: float = KEEP, seed: int = 23) -> DataFrame:
    """The selected rows of ``docs``, all columns as they were."""
    return _mix(docs, False, topic, temper, keep, seed).filter("__mix_selected").select([F.col(f"`{c}`") for c in docs.columns])


def _mix(docs: DataFrame, narrow: bool, topic: Column | None, temper: dict[str, float], keep: float, seed: int) -> DataFrame:
    tables = Scratch(docs.sparkSession, "mixing")
    new = {x: x if narrow else f"__mix_{x}" for x in ("topic", "n_tokens", "weight", "probability", "selected")}
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    kind = topic if topic is not None else topic_of(F.col("text"))
    marked = docs.select(*[c for c in docs.columns if c not in new.values()], kind.alias(new["topic"]), tokens_of(F.col("text")).alias(new["n_tokens"]),
                         name(F.col("source")).alias("__mix_s"), name(F.col("lang")).alias("__mix_l"), name(kind).alias("__mix_t"))
    if narrow:
        marked = tables.keep(marked.drop("text"), "marked")
    cells = tables.keep(marked.groupBy(F.col("__mix_s").alias("source"), F.col("__mix_l").alias("lang"), F.col("__mix_t").alias("topic"))
                        .agg(F.sum(new["n_tokens"]).alias("tokens"), F.count("*").alias("docs")), "cells")
    table, _ = rake(cells, targets(cells, temper))
    table = table.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    top, n_cells = table.agg(F.max("rate"), F.count("*")).first()
    table = table.withColumn("rate", F.col("rate") / F.lit(top or 1.0))
    scale = rate_scale(table, keep)
    odds = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(min(scale, 1e30)) * F.col("rate"))).otherwise(1.0)
    drawn = table.select(F.col("source").alias("__mix_s"), F.col("lang").alias("__mix_l"), F.col("topic").alias("__mix_t"), F.col("weight").alias(new["weight"]), odds.alias(new["probability"]))
    drawn = F.broadcast(drawn) if n_cells <= BROADCAST_CELLS else drawn
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    return (marked.join(drawn, ["__mix_s", "__mix_l", "__mix_t"]).drop("__mix_s", "__mix_l", "__mix_t")
            .withColumn(new["selected"], chance < F.col(new["probability"])))
