"""Order MinHash: fingerprints of whole texts that follow the edit distance.

Every k-mer of code points gets its occurrence number in the text.  For each of
``N_HASHES`` seeded hash functions the ``PICKS`` numbered k-mers of least hash are
taken, put back into the order of the text, and the tuple is hashed to one
component.  Two texts agree in a component if the same k-mers were picked in the
same order, so moved blocks count as edits, other than under a set sketch.

Texts shorter than k are one k-mer.  An empty or null text has the fingerprint
of no k-mers: like another empty text (1), unlike any other (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, utf8

KMER = 6
PICKS = 2
N_HASHES = 64
#: k-mers whose hashes are compared at a time; bounds memory for very long texts.
BLOCK = 1 << 12

_RNG = np.random.default_rng(20190701)
_MULT = _RNG.integers(0, 2**32, N_HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered_kmers(points: np.ndarray, k: int = KMER) -> np.ndarray:
    """A 64-bit hash of each (k-mer, occurrence number), in the order of the text."""
    n = max(len(points) - k + 1, min(1, len(points)))
    code = np.full(n, len(points[:k]), dtype=np.uint64)
    for i in range(min(k, len(points))):
        code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + points[i:i + n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if n else np.zeros(0, int)
    nth = np.empty(n, dtype=np.uint64)
    nth[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return _mix(code + nth * np.uint64(0xD1B54A32D192ED03))


def signature(points: np.ndarray) -> np.ndarray:
    """``N_HASHES`` components of 32 bits; all 0 for no k-mers."""
    base = numbered_kmers(points)
    if not len(base):
        return np.zeros(N_HASHES, dtype=np.uint32)
    low = (base >> np.uint64(32)).astype(np.uint32)
    picks = min(PICKS, len(base))
    rows = np.arange(N_HASHES)
    least, where = [], []
    for at in range(0, len(low), BLOCK):
        # odd multipliers are bijections of 32 bits, so ties need equal ``low``
        h = np.multiply.outer(_MULT, low[at:at + BLOCK])
        for _ in range(min(picks, h.shape[1])):
            i = h.argmin(axis=1)
            least.append(h[rows, i])
            where.append(i + at)
            h[rows, i] = np.uint32(0xFFFFFFFF)
    chosen = np.stack(where, axis=1)
    if chosen.shape[1] > picks:
        chosen = np.take_along_axis(chosen, np.argsort(np.stack(least, axis=1), axis=1, kind="stable")[:, :picks], axis=1)
    chosen.sort(axis=1)  # back into the order of the text
    value = np.arange(1, N_HASHES + 1, dtype=np.uint64)
    for c in range(picks):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) ^ base[chosen[:, c]])
    return np.maximum(value >> np.uint64(32), 1).astype(np.uint32)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components."""
    return float(np.mean(a == b))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def edited(text: str, following: str) -> str:
    """The last third replaced by as many code points of the next text, or all it has."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and the fingerprint of every text: no exchange at all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "fingerprint": pa.array([as_text(signature(code_points(t))) for t in texts], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_chars long, fingerprint string")


NEIGHBOUR_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                    "near_edited double, near_next double")


def against_next(docs: DataFrame) -> DataFrame:
    """Each text against its edited form and against the next document.

    Next means descending doc_id, after the last the first; rows that share an id
    follow each other by descending text, and a null id comes last.  A single
    document is its own next.  The ids are cut into ranges at approximate
    quantiles; a range gets the first row of the range after it as a sentinel,
    so that no window spans the table and one exchange of the texts is enough.
    Null texts are empty, texts of any length count whole, other columns play no
    part, and an empty table gives none.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), "doc_id", utf8(F.col("text")).alias("raw"))
    n = 4 * partitions(spark)
    cuts = base.agg(F.percentile_approx("__id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    if not cuts:
        return spark.createDataFrame([], NEIGHBOUR_SCHEMA)
    cuts = sorted(set(cuts))

    @F.pandas_udf("int")
    def cut_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(cuts, dtype=np.int64), ids.to_numpy(), side="left").astype(np.int32))

    ranged = base.withColumn("range", cut_of("__id"))
    # one row a range: its greatest id, which opens it
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max("__id").alias("top")).collect()}
    used = sorted(tops, reverse=True)
    # the range that ends just before each opening id; around the end for the first: one row a range
    openers = spark.createDataFrame([(tops[r], used[i - 1]) for i, r in enumerate(used)], "__id long, range int")
    # of rows that share the greatest id, the greatest text opens the range
    firsts = base.join(F.broadcast(openers), "__id").groupBy("__id", "range").agg(F.max("raw").alias("raw"))
    firsts = firsts.select("__id", F.lit(None).cast("long").alias("doc_id"), "raw", "range", F.lit(True).alias("sentinel"))
    dealt = ranged.withColumn("sentinel", F.lit(False)).unionByName(firsts)
    lined = dealt.repartition(len(used), "range").sortWithinPartitions(F.desc("range"), F.asc("sentinel"), F.desc("__id"), F.desc("raw"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, text, range, signature
        rows: list[tuple] = []
        for batch in batches:
            for ident, raw, rng, sentinel in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "raw", "range", "sentinel")), strict=True):
                text = raw.decode("utf-8")
                sig = signature(code_points(text)) if held is None or text != held[1] else held[3]
                if held is not None and held[2] == rng:
                    new = edited(held[1], text)
                    new_sig = signature(code_points(new)) if new != held[1] else held[3]
                    rows.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), as_text(held[3]), as_text(new_sig),
                                 likeness(held[3], new_sig), likeness(held[3], sig)))
                held = None if sentinel else (ident, text, rng, sig)
            if rows:
                yield _batch(rows)
                rows = []

    return lined.select("doc_id", "raw", "range", "sentinel").mapInArrow(work, NEIGHBOUR_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in NEIGHBOUR_SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in NEIGHBOUR_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
