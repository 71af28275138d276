"""Claims of a version feed as keyed state: the live claim of every (corpus, document, key), retirements sent as changes.

The state of a document is its newest version's number and a map of its live claims by key. A version sets its claims and
retires those it no longer holds; a deletion retires all. Versions that come behind a newer one change nothing. Changes go
to a stored table by merge under the micro-batch's number, so a batch that runs again after a failure is applied once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators import merges

CHANGE = "corpus_id string, doc_id long, key string, claim_id string, val long, version_number int, deleted boolean"
STORED = "corpus_id string, doc_id long, key string, claim_id string, val long, version_number int"
KEYS = ("corpus_id", "doc_id", "key")
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LiveClaims(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "number int")
        self.live = handle.getMapState("live", "key string", "claim_id string, val long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        corpus, doc = key
        number = self.newest.get()[0] if self.newest.exists() else 0
        changes = []
        for version in pd.concat(list(rows)).sort_values("version_number").itertuples():
            if version.version_number <= number:
                continue
            number = version.version_number
            given = {} if version.event == "DELETED" else {c["key"]: (c["claim_id"], int(c["val"])) for c in version.claims}
            for k in [x[0] for x in self.live.keys()]:
                if k not in given:
                    claim, val = self.live.getValue((k,))
                    self.live.removeKey((k,))
                    changes.append((corpus, doc, k, claim, val, number, True))
            for k, value in given.items():
                self.live.updateValue((k,), value)
                changes.append((corpus, doc, k, *value, number, False))
        if number:
            self.newest.update((int(number),))
        yield pd.DataFrame(changes, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def claim_changes(versions: DataFrame) -> DataFrame:
    """A stream of (corpus_id, doc_id, version_number, event, claims: array of key, claim_id, val) -> CHANGE rows."""
    return versions.groupBy("corpus_id", "doc_id").transformWithStateInPandas(LiveClaims(), CHANGE, "Append", "None")


def keep_live_claims(versions: DataFrame, folder: str, root: str) -> None:
    """Runs the stream over all that is there; the table at root holds the live claims after each batch."""
    spark = versions.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)

    def each(rows: DataFrame, batch: int) -> None:
        if batch in merges.batches(spark, root):  # applied before a failure: the stream's own state still has to be kept
            rows.write.format("noop").mode("overwrite").save()
        else:
            merges.merge(root, batch, rows, KEYS, STORED, order="version_number")

    try:
        start = claim_changes(versions).writeStream.foreachBatch(each)
        start.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def live_claims(spark, root: str) -> DataFrame:
    return merges.read(spark, root, STORED)


def nested_versions(v: DataFrame, c: DataFrame) -> DataFrame:
    """Versions with their claims, as the feed delivers them."""
    held = c.groupBy("version_id").agg(F.collect_list(F.struct("key", "claim_id", F.col("val").cast("long").alias("val"))).alias("claims"))
    none = F.array().cast("array<struct<key:string,claim_id:string,val:long>>")
    return v.join(held, "version_id", "left").select("corpus_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("version_number").cast("int").alias("version_number"), "event", F.coalesce("claims", none).alias("claims"))
