"""Registry helpers, and the test tables as episodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import episodes as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: A step of ``events`` fails above this value.
LIMIT = 250.0
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
CHANNELS = ("quantity", "price", "discount", "tax")


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def wrap(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """states(ep, t, x): one episode a user, steps by time."""
    return E.number_steps(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), {"x": F.col("value")})


def event_episodes(states: DataFrame) -> DataFrame:
    return E.first_failures(states, F.col("x") > LIMIT)


def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """states(ep, t, quantity, price, discount, tax): one episode a supplier, steps by shipping date."""
    return E.number_steps(table(spark, sf_dir, "lineitem"), "l_suppkey", LINE_ORDER,
                          {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax")})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


#: The same in SQL, for oracles.
EVENTS = """states AS MATERIALIZED (SELECT user_id AS ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x FROM events),
episodes AS (SELECT ep, count(*) AS n_steps, coalesce(min(CASE WHEN x > 250 THEN t END), count(*)) AS fail FROM states GROUP BY ep)"""
LINES = """states AS MATERIALIZED (SELECT l_suppkey AS ep, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS t,
l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""


def rank_sql(seed: int, key: str = "ep") -> str:
    return f"md5(concat({key}::VARCHAR, ':', '{seed}'))"


def split_sql(seed: int = 0, survival_only: bool = True) -> str:
    """CTEs ``split`` (ep, n_steps, fail, split) of the stratified four-way split; failures are in test, or in train too."""
    ranked = lambda where, at: f"SELECT *, row_number() OVER (ORDER BY {rank_sql(at)}, ep) AS pos, count(*) OVER () AS n FROM episodes WHERE {where}"
    cut = "CASE WHEN pos <= floor(round(n * 0.4, 9)) THEN 'train' WHEN pos <= floor(round(n * 0.6, 9)) THEN 'norm' WHEN pos <= floor(round(n * 0.8, 9)) THEN 'cal' WHEN pos <= floor(round(n * 1.0, 9)) THEN 'test' END"
    broken = "'test'" if survival_only else "CASE WHEN pos <= floor(round(n * 2 / 3.0, 9)) THEN 'train' ELSE 'test' END"
    return (f"good AS ({ranked('fail = n_steps', seed)}), bad AS ({ranked('fail < n_steps', seed + 1)}), "
            f"split AS (SELECT ep, n_steps, fail, {cut} AS split FROM good UNION ALL SELECT ep, n_steps, fail, {broken} AS split FROM bad)")


VECTORS = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
