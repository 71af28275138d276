"""Activity over the event feed as Structured Streaming jobs: closed tumbling, sliding and session windows, appended exactly once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.durable import shared_folder


def windowed_activity(events: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """ts, event_type -> events per closed window and type. Rows later than `delay` behind the newest are left out.

    With `slide`, windows of that width begin at every slide, and an event counts in each that holds it.
    """
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, by: str, gap: str, delay: str) -> DataFrame:
    """ts, by -> closed sessions: runs of events of one `by` that lie no more than `gap` apart, with their first and last time.

    The state of a running session is its bounds and counts, merged batch by batch, never its events.
    """
    w = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return w.select(by, F.col("w.start").alias("first"), "last", "n")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now; its checkpoint and its Parquet sink lie in the shared folder."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
