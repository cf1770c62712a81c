"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node it reaches.

    A round links, for each node, its larger neighbours and then its smaller ones to
    the least; it ends when every node hangs on one node and that on none.  Least
    neighbours are pre-aggregated minima; nodes with very many edges are joined with
    theirs by broadcast, so no hub meets in one task.  Each step is written to the
    shared folder.  Null ends and loops are no edges; repeated edges count once.
    """
    tables = Scratch(edges.sparkSession, "components")
    now = tables.keep(edges.select("a", "b").filter("a <> b").distinct(), "stars")
    turned = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    for _ in range(rounds):
        both = now.unionByName(turned(now))
        least = tables.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        # now every edge is (greater, less): the small star of its greater end
        large = join_hot(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = tables.keep(large, "large")
        lower = tables.keep(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lower")
        hung = join_hot(large, lower, "a")
        after = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        before, now = now, tables.keep(after, "next")
        # stable once no target of an edge hangs on another node and none hangs on two
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        moving = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").limit(1).count()
        tables.drop("least", "large", "lower", "stars")
        tables.made = {p: "stars" if n == "next" else n for p, n in tables.made.items()}
        del before
        if not moving:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
