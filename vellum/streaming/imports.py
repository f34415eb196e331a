"""Incremental import as a stream: an extension, as the reference has batches only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.functions import text as T


def hashed(stream: DataFrame, text: str = "current_text") -> DataFrame:
    return stream.withColumn("content_hash", T.content_hash(F.col(text)))


def first_seen(stream: DataFrame, event_time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each content hash once; the watermark bounds the state."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def activity(stream: DataFrame, event_time: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and type."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of what is available to a Parquet folder."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
