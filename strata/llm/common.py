"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table of a few longs that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; an error where a cluster's session has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and context.master.startswith("local"):  # one machine, as in tests
            path = tempfile.mkdtemp(prefix="checkpoints-")
        if path is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir.

    The files of its shuffles go at once, as nothing reads them any more; else they'd stay on the executors' disks until
    the driver collects its garbage, and a query of many steps would need room for all of them.
    """
    checkpoints(df.sparkSession)
    with _set(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint()  # a frame of its own, as the setting counts when a frame is made


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, for tables and files that executors write."""
    return f"{checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a path that shared_folder gave, by whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, jobs hand Python workers so many rows at a time at most: whole texts make large batches, which
    stand in memory several times over, in the executor and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with _set(spark, name, before if 0 < int(before) <= rows else str(rows)):
        yield


#: glibc's way to give freed memory back, which it keeps after arrays of some MB otherwise; other libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def ease() -> None:
    """Give the memory of past batches, which Arrow and the C library keep for later ones, back to the executor's machine:
    a worker that waits for its next stage stands in the executor's memory with all that it has kept."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def if_small(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small, with a broadcast hint if it has at most BROADCAST_ROWS rows.

    Give a checkpointed table, as it is counted; above the limit the join shuffles both sides.
    """
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def text_of(name: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the space and U+0009 to U+000D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def needs(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of df, so that what else it holds cannot clash."""
    return df.select(*names)
