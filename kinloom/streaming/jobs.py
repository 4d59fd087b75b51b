"""Latest job status from a stream of events, and its delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest_status(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One row for each job, its last event by time: a mergeable aggregate, so state is one row a job.

    The watermark drops events later than `late`; since time is no grouping
    key, it doesn't expire a job, and state holds a small row for every job.
    """
    last = F.max(F.struct("at", "status", "progress"))
    return events.withWatermark("at", late).groupBy("job_id").agg(last.alias("last"), F.count("*").alias("events")).select("job_id", "last.*", "events")


def deliver(updates: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each changed job to send(batch, number); a failed batch is sent again after a restart."""
    writer = updates.writeStream.outputMode("update").foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def only_new(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Stream-static: rows whose key is not cached yet."""
    return rows.join(cache.select(key), key, "left_anti")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Event counts by time window and status (an addition)."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return events.withWatermark("at", late).groupBy(w, "status").agg(F.count("*").alias("n"))
