"""Small helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one part of an exchange is made of, about; the number of parts follows the input.
PART_BYTES = 64 << 20
#: A key with more rows than this may be joined by broadcast; see ``join_hot``.
HOT_ROWS = 256

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a folder of our own is set, if all runs on one
    machine; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="driftloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, as ``file:///...`` or ``hdfs://...``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = store.makeQualified(target).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; nothing happens once the session is gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway may be closed at exit
        return


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a scratch table; nothing happens once the session is gone."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the gateway may be closed at exit
        return


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """The scratch tables of one run of an operator, below the shared folder.

    What is left goes when the driver ends.  Two runs in one session have folders
    of their own.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = qualified(spark, f"{shared_dir(spark).rstrip('/')}/driftloom-{name}-{uuid.uuid4().hex}")
        self.made: dict[str, str] = {}
        atexit.register(drop_path, spark, self.root)

    def path(self, name: str) -> str:
        """A new path; a later table of the same name gets another one."""
        where = f"{self.root}/{len(self.made)}-{name}"
        self.made[where] = name
        return where

    def keep(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Writes ``df`` and reads it again: lineage ends here, and the shuffle files of the write go.

        ``batch``: rows of an Arrow batch at most, where rows are whole texts.
        """
        where = self.path(name)
        values = {FREE_SHUFFLES: "true"}
        if batch:
            now = int(self.spark.conf.get(BATCH_ROWS))
            values[BATCH_ROWS] = str(min(now, batch) if now > 0 else batch)
        with settings(self.spark, values):
            df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names."""
        for where, name in list(self.made.items()):
            if name in names:
                drop_path(self.spark, where)
                self.made[where] = ""

    def clear(self, keep: tuple[str, ...] = ()) -> None:
        """Deletes all tables but those named in ``keep``."""
        self.drop(*{n for n in self.made.values() if n and n not in keep})


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here."""
    return Scratch(df.sparkSession, name).keep(df, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def parts_for(spark: SparkSession, n_bytes: int) -> int:
    """Parts of an exchange of so many bytes of text: those of the session, or more for a larger input."""
    return max(partitions(spark), -(-int(n_bytes) // PART_BYTES))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts, roughly (characters): one narrow pass."""
    return docs.agg(F.sum(F.length(col))).first()[0] or 0


def join_hot(rows: DataFrame, stats: DataFrame, on: str | list[str], count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``stats``, which has one row a key and, in ``count``, the rows of that key.

    Keys with more than a quarter of a partition's share of the rows are joined by
    broadcast: there are at most four for each partition, however large the tables.
    The others meet by exchange.  Both sides are read twice: pass written tables.
    """
    total, top = stats.agg(F.sum(count), F.max(count)).first()
    limit = max(HOT_ROWS, (total or 0) // (4 * partitions(rows.sparkSession)))
    if (top or 0) <= limit:
        return rows.join(stats, on)
    hot = stats.filter(F.col(count) > limit)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(stats.filter(F.col(count) <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def utf8(col: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.encode(col, "UTF-8"), F.lit(b"").cast("binary"))


def pieces(raw: bytes, separator: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes, each but the last ending before a match of ``separator`` (one byte)."""
    at, pattern = 0, re.compile(separator)
    while at < len(raw):
        found = pattern.search(raw, at + size) if len(raw) - at > size else None
        stop = found.start() if found else len(raw)
        yield raw[at:stop] if at or found else raw
        at = stop


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
