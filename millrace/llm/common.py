"""What the training-data operators share: tables, the shared folder, words and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The six code points that separate words: space, and U+0009 to U+000D.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"

#: Rows, and bytes of strings, that a Python worker turns into objects at a time; they bound its memory, not what
#: is read. A row that is longer by itself is taken alone.
ROWS_AT_A_TIME, BYTES_AT_A_TIME = 512, 8 << 20


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it until no column of df is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. A local
    folder stands in only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        at = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the application's own folder, which goes when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        fs, at = hadoop_fs(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_own: set[str] = set()
#: What stored() wrote within scratch().
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives
    lost executors, and gives the planner a real size. scratch() or release() removes such tables, and the
    end of the application. lasting: scratch() leaves it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if not lasting and (written := _written.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end the tables that stored() wrote within it, but for lasting ones."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(token)
        for path in paths:
            fs, at = hadoop_fs(spark, path)
            fs.delete(at, True)


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM's Hadoop client for path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that stored() wrote, or without any named all of this application's. Call it once nothing
    that reads them is left to run."""
    base = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    paths = {f.rpartition("/")[0] for t in tables for f in t.inputFiles()} if tables else {base}
    for path in paths:
        fs, at = hadoop_fs(spark, path)
        fs.delete(at, True)


#: Bytes of an Arrow batch between the JVM and Python; Spark's own bound counts rows, whatever their length.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Arrow batches of the session get a bound in bytes if its user set none."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in spark.sparkContext.getConf().toDebugString():
        spark.conf.set(bound, str(BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """How many partitions df has before any exchange; grows with its files."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def settled(df: DataFrame, name: str) -> DataFrame:
    """df if it reads tables without an exchange, so that every job over it meets the same rows in the same
    partitions; else a stored copy, of which that is true."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df if "Scan parquet" in plan and not any(x in plan for x in ("Exchange", "QueryStage", "InMemory")) else stored(df, name)


def string_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings of each row, summed up to it; a leading 0."""
    total = np.zeros(batch.num_rows + 1, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            total[1:] += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.cumsum(total)


def edges(batch: pa.RecordBatch, rows: int, size: int) -> list[int]:
    """Where to cut batch so that a part has at most so many rows and, if it has several, at most so many bytes."""
    ends, at, out = string_bytes(batch), 0, [0]
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1
        at = min(at + rows, max(at + 1, fits), batch.num_rows)
        out.append(at)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_A_TIME, size: int = BYTES_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = edges(batch, rows, size)
        for start, end in zip(cut, cut[1:]):
            yield batch.slice(start, end - start)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes without decoding; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema
    )


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's longs."""
    return values.view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint64)
