"""Incremental ingest as a file stream: each batch is upserted into a versioned table.

The checkpoint takes the place of a cursor and a high-water mark. A version is a new folder;
a pointer file names the current one, so a table is never overwritten while it is read, and a
replayed batch finds its rows in place already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The greatest version whose write was finished; -1: none."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return -1
        done = [s.getPath() for s in fs.listStatus(path(self.path)) if s.getPath().getName().startswith("v=") and fs.exists(path(f"{s.getPath()}/_SUCCESS"))]
        return max((int(p.getName()[2:]) for p in done), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v}")

    def write(self, df: DataFrame, keep: int = 2) -> None:
        v = self.version()
        df.write.mode("overwrite").parquet(f"{self.path}/v={v + 1}")
        fs, path = self._fs()
        for old in range(v + 2 - keep, -1, -1):
            if old > v + 1 - keep or not fs.delete(path(f"{self.path}/v={old}"), True):
                break


def stream_upsert(source: DataFrame, table: VersionedTable, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> None:
    """Takes in all files there are now, then stops. merge(stored, fresh) gives the new state."""

    def batch(fresh: DataFrame, batch_id: int) -> None:
        table.write(merge(table.read(), fresh))

    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
