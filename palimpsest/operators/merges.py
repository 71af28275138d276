"""Stored keyed tables that take merges: upserts, conditional upserts, deletes, replaced groups, erasure.

A table lies in hash buckets of its key. A merge reads and writes the buckets that its rows fall in, under its batch's
number, and then a manifest that says which batch holds each bucket now. The manifest is one small file, so a batch is there
whole or not at all: a job that dies before it leaves the table as it was, running it again overwrites its own files, and a
batch that is there already does nothing. Readers name the folders of the newest manifest; older ones serve time travel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.stored import vector_work

BUCKETS = 32
GONE = ("deleted", "absent")


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of the shared store, none where it does not exist."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that are there."""
    found = [n for n in _children(spark, f"{root}/_manifest") if n.startswith("batch=")]
    return sorted(int(n[6:]) for n in found if "_SUCCESS" in _children(spark, f"{root}/_manifest/{n}"))


def _places(spark: SparkSession, root: str, batch: int) -> dict[int, int]:
    """bucket -> the batch that holds it, of buckets with rows: one entry a bucket."""
    rows = spark.read.schema("bucket int, at int, n long").parquet(f"{root}/_manifest/batch={batch}").collect()
    return {r["bucket"]: r["at"] for r in rows if r["n"]}


def read(spark: SparkSession, root: str, schema: str, batch: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table's rows now, or as of a batch; only some buckets where they are named."""
    there = [b for b in batches(spark, root) if batch is None or b <= batch]
    places = _places(spark, root, there[-1]) if there else {}
    paths = [f"{root}/data/batch={at}/bucket={b}" for b, at in sorted(places.items()) if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, _outcome string").parquet(*paths).where(~F.col("_outcome").isin(*GONE)).drop("_outcome")


def bucket_of(keys: Sequence[str], n: int = BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _commit(spark: SparkSession, root: str, batch: int, rows: DataFrame, schema: str) -> None:
    """Writes rows (with bucket and _outcome), then the manifest: buckets in which nothing happened stay where they are.

    Rows of a bucket are brought together first, as each task writes a file for each bucket that it holds."""
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/batch={batch}")
    written = spark.read.schema(f"{schema}, _outcome string, bucket int").parquet(f"{root}/data/batch={batch}")
    happened = F.max(~F.col("_outcome").isin("kept", "unchanged", "absent"))
    counted = {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count_if(~F.col("_outcome").isin(*GONE)).alias("n"), happened.alias("happened")).where("happened").collect()}
    there = [b for b in batches(spark, root) if b < batch]
    before = _places(spark, root, there[-1]) if there else {}
    now = [(b, at, 1) for b, at in before.items() if b not in counted] + [(b, batch, n) for b, n in counted.items()]
    spark.createDataFrame(now, "bucket int, at int, n long").coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest/batch={batch}")


def merge(root: str, batch: int, changes: DataFrame, keys: Sequence[str], schema: str, order: str | None = None, same: Sequence[str] = (), keep: Sequence[str] = (), buckets: int = BUCKETS) -> None:
    """Upserts and deletes one row a key. changes: the table's columns and deleted; of several rows of a key the last by
    `order` counts.

    A row equal in the columns `same` (nulls equal) changes nothing; with none named, every row writes. Columns in `keep` stay
    as they were when a row is updated. Rows with a null key are left out.
    """
    spark = changes.sparkSession
    if batch in batches(spark, root):
        return
    columns = [c for c in changes.columns if c != "deleted"]
    values = [c for c in columns if c not in keys]
    last = F.max_by(F.struct(*values, "deleted"), F.col(order) if order else F.lit(0)).alias("_new")
    new = changes.dropna(subset=list(keys)).groupBy(*keys).agg(last).withColumn("bucket", bucket_of(keys, buckets))
    new.write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
    new = spark.read.schema(new.schema).parquet(f"{root}/changes/batch={batch}")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    old = read(spark, root, schema, batch - 1, touched).select(*keys, F.struct(*values).alias("_old"), bucket_of(keys, buckets).alias("_b"))
    j = old.join(new, list(keys), "full_outer").withColumn("bucket", F.coalesce("bucket", "_b"))
    there, given = F.col("_b").isNotNull(), F.col("_new").isNotNull()
    equal = F.lit(bool(same))
    for c in same:
        equal = equal & F.col(f"_old.`{c}`").eqNullSafe(F.col(f"_new.`{c}`"))
    outcome = F.when(~given, "kept").when(F.col("_new.deleted"), F.when(there, "deleted").otherwise("absent")).when(~there, "added").when(equal, "unchanged").otherwise("changed")
    j = j.withColumn("_outcome", outcome)
    stays = F.col("_outcome").isin("kept", "unchanged", "deleted")
    value = lambda c: F.when(stays | (there & F.lit(c in keep)), F.col(f"_old.`{c}`")).otherwise(F.col(f"_new.`{c}`")).alias(c)
    _commit(spark, root, batch, j.select(*[F.col(c) if c in keys else value(c) for c in columns], "_outcome", "bucket"), schema)


def replace(root: str, batch: int, rows: DataFrame, groups: DataFrame, keys: Sequence[str], schema: str, buckets: int = BUCKETS) -> None:
    """Replaces all rows of the groups (distinct keys) by those given; a group without rows is gone, rows of others are left out."""
    spark = rows.sparkSession
    if batch in batches(spark, root):
        return
    groups = groups.select(*keys).dropna().distinct().withColumn("bucket", bucket_of(keys, buckets))
    groups.write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
    groups = spark.read.schema(groups.schema).parquet(f"{root}/changes/batch={batch}")
    touched = [r["bucket"] for r in groups.select("bucket").distinct().collect()]
    old = read(spark, root, schema, batch - 1, touched).withColumn("bucket", bucket_of(keys, buckets))
    marked = old.join(groups.drop("bucket").withColumn("_hit", F.lit(True)), list(keys), "left").withColumn("_outcome", F.when(F.col("_hit"), "deleted").otherwise("kept")).drop("_hit")
    fresh = rows.join(groups, list(keys)).withColumn("_outcome", F.lit("added"))
    _commit(spark, root, batch, marked.unionByName(fresh), schema)


def outcomes(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """outcome, n of a batch; rows that it only carried along are not counted."""
    return spark.read.schema("_outcome string").parquet(f"{root}/data/batch={batch}").where("_outcome <> 'kept'").groupBy(F.col("_outcome").alias("outcome")).agg(F.count("*").alias("n"))


def sync(root: str, batch: int, source: DataFrame, keys: Sequence[str], schema: str, same: Sequence[str], keep: Sequence[str] = ()) -> None:
    """The table made equal to its source: upserts of its rows, deletes of keys that it no longer has."""
    gone = read(source.sparkSession, root, schema, batch - 1).join(source.select(*keys), list(keys), "left_anti")
    merge(root, batch, source.withColumn("deleted", F.lit(False)).unionByName(gone.select(source.columns).withColumn("deleted", F.lit(True))), keys, schema, same=same, keep=keep)


def erase(tables: dict[str, tuple[str, str, Sequence[str]]], corpus: str, batch: int, spark: SparkSession) -> DataFrame:
    """Erases a corpus from every table (name -> root, schema, keys) -> table_name, removed, left; one row `corpus_not_found`
    (nulls) where no table held it. Other corpora's rows stay as they are."""
    report = None
    for name, (root, schema, keys) in tables.items():
        rows = read(spark, root, schema, batch - 1).where(F.col("corpus_id") == corpus)
        replace(root, batch, rows.limit(0), rows, keys, schema)
        counted = read(spark, root, schema, batch).agg(F.count("*").alias("left"))
        gone = spark.read.schema("_outcome string").parquet(f"{root}/data/batch={batch}").agg(F.count_if(F.col("_outcome") == "deleted").alias("removed"))
        one = gone.join(counted, F.lit(True)).select(F.lit(name).alias("table_name"), "removed", "left")  # one row each
        report = one if report is None else report.unionByName(one)
    found = report.agg(F.sum("removed").alias("n")).where("n = 0").select(F.lit("corpus_not_found").alias("table_name"), F.lit(None).cast("long").alias("removed"), F.lit(None).cast("long").alias("left"))
    return report.unionByName(found)


def embed_with(encode: Callable[[list[str]], list[list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """A work list (hash, text) -> hash, vector by a vectorised function of texts, an Arrow batch at a time."""

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"hash": part["hash"], "vector": encode(part["text"].tolist())})

    return lambda work: work.mapInPandas(run, "hash string, vector array<double>")


VECTORS = "hash string, vector array<double>, model string"


def backfill(root: str, batch: int, claims: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str) -> None:
    """Encodes texts (claim_id, text) whose hash the store lacks, each once, and adds them; a rerun encodes nothing."""
    spark = claims.sparkSession
    if batch in batches(spark, root):
        return
    work = vector_work(claims, read(spark, root, VECTORS, batch - 1).where(F.col("model") == model))
    texts = work.select("hash", F.col("first_id").alias("claim_id")).join(claims, "claim_id").select("hash", "text")
    rows = embed(texts).select("hash", "vector", F.lit(model).alias("model"), F.lit(False).alias("deleted"))
    merge(root, batch, rows, ["hash"], VECTORS, same=["model"])
