"""The feed as it arrives: late events set aside, a snapshot sealed at each trigger, verdicts counted for logged calls.

Each micro-batch writes its rows under its own number in a shared folder, so a batch that runs again after a failure
overwrites its own files and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import subjects
from palimpsest.streaming.activity import drain


def _run(stream: DataFrame, folder: str, each) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def _earlier(spark: SparkSession, folder: str, name: str, batch: int) -> DataFrame | None:
    """The rows that earlier batches wrote under a name."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").where(F.col("batch") < batch) if batch else None


def split_late(stream: DataFrame, folder: str, delay: str) -> None:
    """Rows (with ts) go to folder/on_time, those more than `delay` behind the newest of earlier batches to folder/late."""

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = _earlier(spark, folder, "newest", batch)
        bound = before.agg((F.max("ts") - F.expr(f"interval {delay}")).alias("t")).first()["t"] if before is not None else None
        late = F.coalesce(F.col("ts") < F.lit(bound), F.lit(False)) if bound is not None else F.lit(False)
        rows = rows.persist()
        rows.where(~late).write.mode("overwrite").parquet(f"{folder}/on_time/batch={batch}")
        rows.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
        rows.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{folder}/newest/batch={batch}")
        rows.unpersist()

    _run(stream, folder, each)


def seal_snapshots(stream: DataFrame, folder: str) -> None:
    """Versions (version_id, corpus_id, observed_at): after each trigger folder/sealed holds the cutoff and the members so far."""

    def each(rows: DataFrame, batch: int) -> None:
        members = rows.groupBy("corpus_id").agg(F.count("*").alias("n"), F.max("observed_at").alias("cutoff"))
        before = _earlier(rows.sparkSession, folder, "sealed", batch)
        if before is not None:  # the last snapshot has the sums of all earlier ones
            members = members.unionByName(before.where(F.col("batch") == batch - 1).select("corpus_id", "n", "cutoff")).groupBy("corpus_id").agg(F.sum("n").alias("n"), F.max("cutoff").alias("cutoff"))
        members.coalesce(1).write.mode("overwrite").parquet(f"{folder}/sealed/batch={batch}")

    _run(stream, folder, each)


def verdict_counts(calls: DataFrame, verdicts: DataFrame, folder: str, within: str) -> DataFrame:
    """Logged calls (query_id, ts, match_status) joined with the verdicts (query_id, verdict, judged_at) given within a time."""
    c, v = calls.withWatermark("ts", within).alias("c"), verdicts.withWatermark("judged_at", within).alias("v")
    on = (F.col("c.query_id") == F.col("v.query_id")) & (F.col("v.judged_at") >= F.col("c.ts") - F.expr(f"interval {within}")) & (F.col("v.judged_at") <= F.col("c.ts") + F.expr(f"interval {within}"))
    joined = drain(c.join(v, on).select("c.query_id", "c.match_status", "v.verdict"), folder)
    return joined.groupBy("match_status", "verdict").agg(F.count("*").alias("n"))


def store_index(index: tuple[DataFrame, DataFrame], folder: str) -> None:
    """Postings and number of documents of a term index, as the batches of a stream read them."""
    index[0].write.mode("overwrite").parquet(f"{folder}/index/postings")
    index[1].write.mode("overwrite").parquet(f"{folder}/index/n_docs")


def hint_stream(statements: DataFrame, folder: str) -> None:
    """A stream of statements (statement_id, text): each batch's hints against the index stored in the folder, under its number."""

    def each(rows: DataFrame, batch: int) -> None:
        index = tuple(rows.sparkSession.read.parquet(f"{folder}/index/{name}") for name in ("postings", "n_docs"))
        subjects.hints(rows, index).write.mode("overwrite").parquet(f"{folder}/hints/batch={batch}")

    _run(statements, folder, each)


def hints_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/hints").parquet(f"{folder}/hints").drop("batch")
