"""Streams of job and progress events. Event-time windows are an addition; the batch forms are in ``operators.queue``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def latest_progress(events: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The last value of each key so far, for an update-mode sink."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(at, value)).alias(value))


def finished_per_window(events: DataFrame, *, at: str = "completed", window: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Jobs finished in each window; events later than ``late`` are left out."""
    counts = events.where(F.col("status") == "done").withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("done"))
    return counts.select(F.col("window.start").alias("start"), "done", (F.col("done") * (3600 / 900)).cast("long").alias("hourly"))


def drain_once(done: DataFrame, keys: list[str], *, late: str = "72 hours", at: str = "completed") -> DataFrame:
    """Each source once, as long as its repeats come within ``late``."""
    return done.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def consume(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Run ``write`` on each micro-batch. With ``every`` it polls; without, it takes what is there and ends.

    A batch can be repeated after a failure; ``write`` gets its number, with which it can write idempotently.
    """
    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
