"""The version feed as streams: exactly-once delivery, the lifecycle of each document as state, latest values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc_id long, version_id long, version_number int, predecessor_id long, event string, fp string"


def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One document's new writes, in order, against the fingerprint, number and id of its last version."""
    fp, number, last = state.get if state.exists else (None, 0, -1)
    rows = pd.concat(list(parts)).sort_values(["observed_at", "version_id"])
    out = []
    for version, now in zip(rows["version_id"], rows["fp"], strict=True):
        if now == fp or (fp is None and now == "DELETED"):
            continue
        event = "DELETED" if now == "DELETED" else "NEW" if fp is None else "RESTORED" if fp == "DELETED" else "MODIFIED"
        number += 1
        out.append((key[0], version, number, None if fp is None else last, event, now))
        fp, last = now, version
    if number:
        state.update((fp, number, int(last)))
    frame = pd.DataFrame(out, columns=["doc_id", "version_id", "version_number", "predecessor_id", "event", "fp"])
    yield frame.astype({"predecessor_id": "Int64"})


def lifecycle(writes: DataFrame) -> DataFrame:
    """A stream of (user_id, version_id, observed_at, fp) -> versions. A write older than the state comes as a late change.

    A document's writes of one micro-batch are held together; maxFilesPerTrigger bounds them.
    """
    return writes.groupBy("user_id").applyInPandasWithState(advance, OUT, "fp string, number int, last long", "append", GroupStateTimeout.NoTimeout)


def exactly_once(feed: DataFrame, key: str, delay: str) -> DataFrame:
    """Rows delivered twice within the delay come out once."""
    return feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def latest(feed: DataFrame, keys: list[str], value: str, folder: str) -> DataFrame:
    """The latest value of each key, kept as a table that every micro-batch updates."""
    table = feed.groupBy(*keys).agg(F.max_by(value, "ts").alias(value))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    table.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return feed.sparkSession.read.schema(table.schema).parquet(f"{folder}/out")
