"""Proportional stratified interleaving of rows into shards (DataFrame only).

Rows are shuffled by a seeded hash within each source, ranked there, and sorted
by fractional rank ``(rank - 1/2) / rows of the source``; that order interleaves
the sources in proportion, so equal cuts of it have the mixture of the whole.

No global sort takes place.  Both rankings are made in steps: counts per (source,
slice of the hash range) are summed in blocks of slices, running sums over blocks and
inside each block give the rank at which a slice starts, and a window over the slice
alone ranks its few hundred rows.  Keys are written once, without the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows that one slice of a ranking holds on average, and slices of a block.
SLICE_ROWS, BLOCK_SLICES = 512, 1024
HASH_BITS = 52


def _digest(seed: int, cols: list[str]) -> Column:
    """A seeded MD5, which any SQL engine can repeat; nulls are passed over."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in cols]))


def _key(seed: int, cols: list[str]) -> Column:
    """A seeded hash in 0 .. 2**52 - 1."""
    return F.conv(F.substring(_digest(seed, cols), 1, HASH_BITS // 4), 16, 10).cast("long")


def _starts(counted: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each slice, within ``by``, from the slices' counts ``__n``.

    A running sum over blocks and one inside each block: the longest window has
    rows / (SLICE_ROWS * BLOCK_SLICES) rows.
    """
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocked = counted.withColumn("__block", F.floor(F.col("__slice") / BLOCK_SLICES))
    blocks = blocked.groupBy(*by, "__block").agg(F.sum("__n").alias("__n"))
    starts = blocks.withColumn("__start", before(Window.partitionBy(*by).orderBy("__block"))).drop("__n")
    inside = Window.partitionBy(*by, "__block").orderBy("__slice")
    return blocked.withColumn("__before", before(inside)).join(starts, [*by, "__block"]).withColumn("__before", F.col("__before") + F.col("__start")).drop("__start", "__block")


def interleave(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, tie_cols: tuple[str, ...] = (),
               n_shards: int = 24, seed: int = 17) -> DataFrame:
    """Adds ``position`` (0-based, global), ``shard`` and ``slot``.

    Shards are equal cuts: their row counts are at most one apart, and each has
    every source within a few rows of its share.  A null source is a source of
    its own; a null id is passed over by the hash and sorts first.  Repeated rows tie on id and hash;
    they get neighbouring positions (and share a slice), and which of two identical
    rows comes first has no effect.  An empty table gives an empty result.  Input
    columns named ``position``, ``shard`` or ``slot`` are replaced.  ``df`` should be
    narrow: all of its columns are written once and go through three exchanges.
    """
    tables = Scratch(df.sparkSession, "sharding")
    df = df.drop("position", "shard", "slot")
    df = tables.keep(df.withColumn("__key", _key(seed, [id_col, *tie_cols])), "keys")
    total = df.count()
    slices = max(1, total // SLICE_ROWS)
    shift = (1 << HASH_BITS) // slices + 1
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    keyed = df.withColumn("__src", src).withColumn("__slice", F.floor(F.col("__key") / shift))
    order = [F.col(c) for c in (id_col, *tie_cols)]

    sliced = keyed.groupBy("__src", "__slice").agg(F.count("*").alias("__n"))
    sizes = sliced.groupBy("__src").agg(F.sum("__n").alias("__of"))
    starts = _starts(sliced, ["__src"]).drop("__n").join(sizes, "__src")
    w = Window.partitionBy("__src", "__slice").orderBy("__key", *order)
    ranked = (keyed.withColumn("__in", F.row_number().over(w)).join(starts, ["__src", "__slice"])
              .withColumn("__frac", (F.col("__before") + F.col("__in") - 0.5) / F.col("__of"))
              .drop("__before", "__in", "__of", "__slice")
              .withColumn("__slice", F.least(F.floor(F.col("__frac") * slices), F.lit(slices - 1))))

    # the same two steps over all rows: fractional ranks fill 0 .. 1 evenly
    tops = ranked.groupBy("__slice").agg(F.count("*").alias("__n"))
    tops = _starts(tops.withColumn("__all", F.lit(0)), ["__all"]).select("__slice", "__before")  # counts of blocks, not rows
    w = Window.partitionBy("__slice").orderBy("__frac", _digest(seed, ["__src"]), "__key", *order)
    placed = (ranked.withColumn("__in", F.row_number().over(w)).join(tops, "__slice")
              .withColumn("position", F.col("__before") + F.col("__in") - 1))
    shard = F.expr(f"(position * {n_shards}) div {max(total, 1)}").cast("int")
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", (F.col("position") - first).cast("long"))
            .drop("__src", "__key", "__slice", "__frac", "__before", "__in"))


def shard_documents(docs: DataFrame, *, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """The manifest of a document table: one row for each row of ``docs``.

    ``size`` is the UTF-8 length plus 8 (null: 8), ``text_crc32`` the checksum of
    the bytes of the whole text, however long.  The law is ``rows``; ``grown_shard``
    is null.  Other columns of ``docs`` play no part.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", F.col("source").alias("__stratum"),
                         (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = interleave(narrow, "doc_id", "__stratum", tie_cols=("text_crc32",), n_shards=n_shards, seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("__stratum").alias("source"), "position")
