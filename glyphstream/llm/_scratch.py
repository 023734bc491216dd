"""Shared storage for intermediate tables, and small helpers used by the operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_local: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local session; on a cluster that is an
    error, as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.TemporaryDirectory(prefix="glyphstream-"))
    return _local[0].name


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/glyphstream/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


# A written table's row groups are held in memory until they are full; Spark's default is 128 MB.
ROW_GROUP_BYTES = 16 << 20
TASK_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
BATCH = {"spark.sql.parquet.columnarReaderBatchSize": 256, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of df's size, as files hold it; for sources that can't tell, a task's share for each core."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 52 else df.sparkSession.sparkContext.defaultParallelism * TASK_BYTES


def width(spark: SparkSession, size: int) -> int:
    """Tasks for ``size`` bytes: a task for each TASK_BYTES, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def materialise(df: DataFrame, label: str, size: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``size`` is a bound on its bytes, or on those it is made of; no more tasks write files
    than that needs, however many partitions a session deals shuffles to.
    """
    path = scratch_path(df.sparkSession, label)
    df.coalesce(width(df.sparkSession, size)).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """As materialise, bucketed by a column; what groups by it, and more, reads the table without a shuffle.

    Buckets need a table in the catalog; it is dropped again at once, as the frame needs its files only.
    Rows are packed blocks of some megabytes, so Parquet doesn't compress them again.
    """
    spark, path, name = df.sparkSession, scratch_path(df.sparkSession, label), f"glyphstream_{uuid.uuid4().hex}"
    # Else Spark shuffles where a grouping has more columns than the buckets.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    df.write.format("parquet").option("path", path).option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "uncompressed").bucketBy(buckets, column).saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return written


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``materialise`` that nothing will read any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict[str, object] = {}


def keep(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks, made once; ``release`` gives it up."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Give back what a Python worker keeps for other operators' tasks, and what its allocators hold."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def delete_scratch() -> None:
    """Delete the tables that this process has written; frames that still read them become invalid."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(delete_scratch)


def exchange_ranges(size: int) -> int:
    """Ranges into which the keys of ``size`` bytes of documents are dealt, RANGE_BYTES for each."""
    return max(16, -(-size // RANGE_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) alone, null texts as empty ones; all other columns stay behind.

    Bounds the session's Arrow batches, as rows here are whole texts: a batch of 10,000 of them
    is held twice, by the JVM and by the Python worker.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bound_batches(spark: SparkSession) -> None:
    for key, most in BATCH.items():
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def held_out(id_col, remainder: int):
    """crc32(id as text) mod 5 equals remainder; a null id counts as not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def utf8_values(column: pa.Array) -> tuple[bytes, list[int]]:
    """The bytes of a string column without nulls, and the offsets of its values."""
    import numpy as np

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (data.to_pybytes() if data is not None else b""), at.tolist()
