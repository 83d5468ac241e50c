"""Streams: windowed event counts with late data, and running summaries of a trace that is still being written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.inference.run import TRACE


def event_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = "2 hours") -> DataFrame:
    """(start, end, event_type, n, total): counts per event-time window; works on streams and on tables.

    On a stream, events later than ``late`` are dropped and windows come out once the watermark has passed them.
    """
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): activity of a user without a pause of ``gap``."""
    got = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Draws of a trace folder as they are committed, block by block."""
    return spark.readStream.schema(TRACE).parquet(folder)


def watch_trace(stream: DataFrame, checkpoint: str, validate: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Calls ``validate(block, number)`` on each new block of draws: the intermediate validation of a running inference."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(validate)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def copy_trace_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a trace stream to another table exactly once."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("chain", "var").trigger(availableNow=True).start()
