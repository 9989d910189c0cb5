"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most: long texts must not pile up in a worker.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a job that runs in here when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    Cuts the lineage: a lost executor costs a re-read of the files. The shuffle files of the write are deleted.
    """
    path = fresh_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    own = shared_dir(spark)
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.dirname(folder).endswith(own.split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class BatchSize:
    """A setting that was lowered and can be put back."""

    def __init__(self, spark: SparkSession, before: str):
        self.spark, self.before = spark, before

    def restore(self) -> None:
        self.spark.conf.set(_BATCH, self.before)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> BatchSize:
    """Lower the session's Arrow batch size for operators that read whole texts."""
    now = spark.conf.get(_BATCH)
    if int(now) <= 0 or int(now) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return BatchSize(spark, now)


_working_on = ""
_forget: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Say how a worker process forgets what an operator's tasks have remembered in it."""
    _forget[operator] = forget


def working_on(operator: str) -> None:
    """Called at the start of an operator's task: the worker forgets what other operators remembered, and gives free memory back.

    Workers outlive stages; without this each task would find them as large as the largest before it left them.
    """
    global _working_on
    if _working_on != operator:
        for other, forget in _forget.items():
            if other != operator:
                forget()
        gc.collect()
        _working_on = operator
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have this
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Rows of a few numbers each that are broadcast at most.
BROADCAST_ROWS = 2_000_000


def small_or_joined(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow rows) marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
