"""Event windows and incremental findings, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.keep import keep


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n) by windows of ts; with `late`, a stream's events later than that are dropped."""
    rows = _timed(events) if late is None else _timed(events).withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, n): runs of a user's events with less than the gap between two."""
    return _timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def stream_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table's files as a stream, so many at a time, in the schema the table has; the table may be one file,
    which a stream reads as a pattern alone."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Events without repeats within the time that late ones are waited for."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def incremental(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], keys: list[str], target: str, checkpoint: str):
    """A query that appends to the table at target what analyse finds in new rows and the table hasn't yet.

    A batch that is run again writes to its own folder again, so nothing is added twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = analyse(batch)
        try:
            before = spark.read.parquet(target).where(F.col("batch") < number).select(*keys)
            found = found.join(before, keys, "left_anti")
        except Exception as none:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(none) and "UNABLE_TO_INFER_SCHEMA" not in str(none):
                raise
        keep(found).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_counts(stream: DataFrame, keys: list[str], target: str, checkpoint: str):
    """A query that appends each batch's counts by keys to the table at target; they are summed on reading.

    A batch that is run again writes to its own folder again, so nothing is counted twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_counts(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, event_type, n): pairs with their number in all batches of the stream."""
    import uuid

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        keep(spark.range(1))
    home = f"{context.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    keys = ["user_id", "event_type"]
    batch_counts(stream_of(spark, path), keys, f"{home}/found", f"{home}/state").awaitTermination()
    return spark.read.parquet(f"{home}/found").groupBy(*keys).agg(F.sum("n").alias("n"))
