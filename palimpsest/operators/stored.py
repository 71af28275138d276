"""The archive as stored tables: appended in batches that count once they are marked, loaded, rebuilt and reset.

A table lies in `root/<name>/batch=<id>/corpus_id=<c>`. A batch is written whole and then marked in `root/_batches`; readers
take marked batches only, so a job that dies in between leaves nothing visible, and running it again overwrites its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(root: str, batch: int, tables: dict[str, DataFrame], commit: bool = True) -> None:
    """Writes a batch of rows to each table, then its mark. Every table has corpus_id."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").partitionBy("corpus_id").parquet(f"{root}/{name}/batch={batch}")
    if commit:
        spark = next(iter(tables.values())).sparkSession
        spark.range(1).select(F.lit(batch).alias("id")).write.mode("overwrite").parquet(f"{root}/_batches/batch={batch}")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of the marked batches; the marks are a row a batch, so Spark broadcasts them by their size and prunes partitions."""
    marks = spark.read.parquet(f"{root}/_batches").select("batch").distinct()
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").join(marks, "batch", "left_semi")


def load_nested(v: DataFrame, c: DataFrame) -> DataFrame:
    """Versions with their claims in key order, in the archive's order (observed_at, path, version_number)."""
    nested = c.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("key", "claim_id", "claim"))).alias("claims"))
    return v.join(nested, "version_id", "left").orderBy("observed_at", "path", "version_number")


def rehydrate(latest: DataFrame, live: DataFrame) -> DataFrame:
    """The live index rebuilt: archived paths hold their latest content, none if it was deleted or is blank; other paths stay.

    latest: corpus_id, path, event, content; live: corpus_id, path, content. Adds origin: rebuilt, removed or live_only.
    """
    gone = (F.col("event") == "DELETED") | (F.trim(F.coalesce("content", F.lit(""))) == "")
    archived = latest.select("corpus_id", "path", F.when(~gone, F.col("content")).alias("content"), F.when(gone, "removed").otherwise("rebuilt").alias("origin"))
    rest = live.join(latest.select("corpus_id", "path"), ["corpus_id", "path"], "left_anti")
    return archived.unionByName(rest.select("corpus_id", "path", "content", F.lit("live_only").alias("origin")))


def replace_chunks(chunks: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks after those of some documents (corpus_id, doc_id) are replaced; a document without fresh ones has none."""
    return chunks.join(documents, ["corpus_id", "doc_id"], "left_anti").unionByName(fresh.join(documents, ["corpus_id", "doc_id"], "left_semi"))


def vector_work(claims: DataFrame, cache: DataFrame) -> DataFrame:
    """claim_id, text and a cache of hashes -> one row for each text yet to embed: its hash, a claim that has it, how many do."""
    hashed = claims.where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("claim_id").alias("first_id"), F.count("*").alias("n"))
    return hashed.join(cache.select("hash"), "hash", "left_anti")


def reset(tables: dict[str, DataFrame], corpus: str, kept: tuple[str, ...] = ("corpora", "grants")) -> dict[str, DataFrame]:
    """Every table without a corpus's rows; the corpus itself and its grants stay."""
    return {name: t if name in kept else t.where(F.col("corpus_id") != corpus) for name, t in tables.items()}


def stages(payloads: DataFrame, deletes: DataFrame) -> DataFrame:
    """What is live after each stage: stage, path, content written and stage, path deleted -> stage, path, content.

    Inside a stage writes come before deletes. Each write holds until the path's next write or delete, so a row comes out for
    every stage it lives through; stages are few and numbered from 0.
    """
    moves = payloads.select("path", "stage", "content", F.lit(False).alias("gone")).unionByName(deletes.select("path", "stage", F.lit(None).cast("string").alias("content"), F.lit(True).alias("gone")))
    last = moves.groupBy("path", "stage").agg(F.max("gone").alias("gone"), F.max("content").alias("content"))
    until = F.lead("stage").over(Window.partitionBy("path").orderBy("stage"))
    end = payloads.select("stage").union(deletes.select("stage")).agg(F.max("stage")).first()[0]
    held = last.withColumn("until", F.coalesce(until, F.lit((end or 0) + 1))).where("not gone")
    return held.select(F.explode(F.sequence("stage", F.col("until") - 1)).alias("stage"), "path", "content")
