"""Tables written below the session's shared folder, at which lineage ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where the session names none and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="driftloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Written:
    """Tables of one run; what is left of them goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", []
        atexit.register(self.clear)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.tables)}"
        df.write.parquet(path)
        self.tables.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, last: int = 0) -> None:
        """Deletes all tables but the ``last`` ones."""
        done = self.tables[:len(self.tables) - last]
        self.tables[:len(done)] = [None] * len(done)
        for path in filter(None, done):
            try:
                target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            except Exception:  # noqa: BLE001  the gateway may be closed at exit
                return
