"""Cutting a plan's lineage in loops, and small tables from fixed values."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a derived table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _folder(df: DataFrame) -> str:
    """The folder of checkpoints, which is set if it isn't yet."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None and context.master.startswith("local"):  # one machine, as in tests
            path = tempfile.mkdtemp(prefix="checkpoints-")
        if path is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """df, computed once into spark.checkpoint.dir, which survives the loss of executors.

    The folder is one that the driver and all executors share, so a cluster's session without the setting is an error.
    """
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once into Parquet files in that folder: for large tables with texts that repeat, which are far smaller
    there than the rows of a checkpoint, and of which only the columns that are used are read again."""
    path = f"{_folder(df)}/written-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A kept table, with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fixed(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A broadcast table of fixed values."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def listed(column, values):
    """Whether a column is among fixed values."""
    return column.isin(*values)
