"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local folder stands in only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        at = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in a folder of the application's own, which goes when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/millrace-steps-{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: worked out once, safe from lost executors, and of a size the planner knows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes under which a table may be a single row group, which one task reads.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small df over all cores, as one row group would keep one of them busy; a larger one as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df
