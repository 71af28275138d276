"""The archive's tables as views over an event stream: versions, claims, chunks and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("view", "click", "signup", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidate_writes(events: DataFrame) -> DataFrame:
    """One write per (user, day), carrying the day's last value of each kind; a delete when its last event is an error."""
    e = events.select("user_id", "event_id", "ts", "event_type", F.to_date("ts").alias("d"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    last = [F.max_by("k", F.when(F.col("event_type") == t, F.col("ts"))).alias(f"v_{t}") for t in KINDS]
    w = e.groupBy("user_id", "d").agg(F.max("ts").alias("observed_at"), F.max("event_id").alias("version_id"), F.max_by("event_type", "ts").alias("last_type"), *last)
    live = F.concat_ws("|", *[F.coalesce(F.col(f"v_{t}").cast("string"), F.lit("-")) for t in KINDS])
    return w.withColumn("fp", F.when(F.col("last_type") == "error", "DELETED").otherwise(live))


def lifecycle(writes: DataFrame) -> DataFrame:
    """Versions: no leading deletes, no unchanged repeats, numbered and linked to their predecessors."""
    order = Window.partitionBy("user_id").orderBy("observed_at", "version_id")
    live = writes.withColumn("seen", F.sum(F.when(F.col("fp") != "DELETED", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("seen > 0")
    kept = live.withColumn("prev_fp", F.lag("fp").over(order)).where("prev_fp is null or prev_fp <> fp")
    event = F.when(F.col("fp") == "DELETED", "DELETED").when(F.col("prev_fp").isNull(), "NEW").when(F.col("prev_fp") == "DELETED", "RESTORED").otherwise("MODIFIED")
    user = F.col("user_id")
    return kept.select(
        F.concat(F.lit("c"), user % 4).alias("corpus_id"), user.alias("doc_id"), F.concat(F.lit("users/"), user % 7, F.lit("/"), user, F.lit(".md")).alias("path"), "version_id",
        F.row_number().over(order).alias("version_number"), F.lag("version_id").over(order).alias("predecessor_id"), event.alias("event"), "observed_at", "fp", "d", *[f"v_{t}" for t in KINDS],
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle(candidate_writes(table(spark, sf_dir, "events")))


def claims(v: DataFrame) -> DataFrame:
    """A claim for every value of a live version, with its validity window and the claim of the predecessor it supersedes."""
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("kind"), F.col(f"v_{t}").alias("val")) for t in KINDS]))
    base = v.where("event <> 'DELETED'").select("corpus_id", "doc_id", "path", "version_id", "version_number", "observed_at", "d", kinds.alias("x")).where("x.val is not null").select("*", "x.kind", "x.val").drop("x")
    c = base.select(
        F.concat_ws(":", F.col("version_id").cast("string"), "kind").alias("claim_id"), "corpus_id", "doc_id", "path", "version_id", "version_number", "observed_at",
        F.concat("kind", F.lit("."), F.floor(F.col("doc_id") / 8)).alias("key"), "val", F.concat("kind", F.lit(" of user "), "doc_id", F.lit(" is "), "val").alias("claim"),
        F.col("d").cast("timestamp").alias("valid_from"), F.when(F.col("val") % 2 == 0, F.date_add("d", 7).cast("timestamp")).alias("valid_until"),
    )
    before = c.select(F.col("doc_id"), F.col("key"), (F.col("version_number") + 1).alias("version_number"), F.col("claim_id").alias("supersedes_id"))
    return c.join(before, ["doc_id", "key", "version_number"], "left")


def with_topic_edges(c: DataFrame) -> DataFrame:
    """Adds edges across documents: to the previous claim of the same key, if another document's and strictly earlier."""
    order = Window.partitionBy("corpus_id", "key").orderBy("observed_at", "claim_id")
    c = c.withColumn("_p", F.lag(F.struct("claim_id", "doc_id", "observed_at")).over(order))
    topic = F.col("supersedes_id").isNull() & (F.col("val") % 5 == 0) & (F.col("_p.doc_id") != F.col("doc_id")) & (F.col("_p.observed_at") < F.col("observed_at"))
    basis = F.when(topic, "topic_key").when(F.col("supersedes_id").isNotNull(), "same_document_key")
    return c.withColumns({"basis": basis, "supersedes_id": F.when(topic, F.col("_p.claim_id")).otherwise(F.col("supersedes_id"))}).drop("_p")


def evidence(c: DataFrame) -> DataFrame:
    """Each claim's quote with offsets into its version's chunk: the version's claims joined by newlines in key order."""
    chunk = c.groupBy("version_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "claim"))), lambda x: x["claim"]), "\n").alias("chunk"))
    start = F.expr("locate(claim, chunk)") - 1
    return c.join(chunk, "version_id").select("claim_id", "version_id", "chunk", F.col("claim").alias("quote"), start.alias("start_offset"), (start + F.length("claim")).alias("end_offset"), "val")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live index: documents with path, type, tags, date and content hash."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("kaggle", "project", "note", "paper"))), (F.col("doc_id") % 4 + 1).cast("int"))
    date = F.when(F.col("doc_id") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")))
    return d.select(F.concat(F.lit("c"), F.col("doc_id") % 4).alias("corpus_id"), F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.substring("text", 1, 40).alias("title"), kind.alias("document_type"), F.array("lang", "source").alias("tags"), date.alias("date"), F.sha2("text", 256).alias("content_hash"), "text")


def line_chunks(d: DataFrame) -> DataFrame:
    """One chunk per non-blank line."""
    return d.select("corpus_id", F.col("id").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("order_index", "text")).where("trim(text) <> ''")
