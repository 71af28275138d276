"""Registered queries of stored tables that take merges, of vector backfill and of claim state from the feed."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import merges
from palimpsest.plans.registry import _DOCS, ARCHIVE_SQL
from palimpsest.sources import archive
from palimpsest.streaming import activity, claim_state

INDEX = "corpus_id string, path string, id long, hash string"


def _changed(column: str = "text"):
    return F.when(F.col("id") % 7 == 0, F.sha2(F.concat(column, F.lit("!")), 256)).otherwise(F.col("content_hash"))


def _synced(spark: SparkSession, d: str) -> str:
    """An index of most documents, then made equal to a source with changed, new and missing ones, twice."""
    root, docs = activity.new_folder(spark), archive.documents(spark, d)
    first = docs.where("id % 10 <> 0").select("corpus_id", "path", F.col("id").cast("long").alias("id"), F.col("content_hash").alias("hash"))
    merges.merge(root, 0, first.withColumn("deleted", F.lit(False)), ["corpus_id", "path"], INDEX)
    source = docs.where("id % 13 <> 0").select("corpus_id", "path", (F.col("id") + 1_000_000_000).cast("long").alias("id"), _changed().alias("hash"))
    for batch in (1, 1, 2):  # 1 again, as after a failure; 2 finds nothing to do
        merges.sync(root, batch, source, ["corpus_id", "path"], INDEX, same=["hash"], keep=["id"])
    return root


def synced_index(spark: SparkSession, d: str) -> DataFrame:
    return merges.read(spark, _synced(spark, d), INDEX)


def sync_batches(spark: SparkSession, d: str) -> DataFrame:
    root = _synced(spark, d)
    rows = [merges.outcomes(spark, root, b).select(F.lit(b).alias("batch"), "outcome", "n") for b in (0, 1, 2)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


CHUNKS = "corpus_id string, doc_id long, order_index int, hash string"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = archive.documents(spark, d)
    c = archive.line_chunks(docs)
    return c.select("corpus_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("order_index").cast("int").alias("order_index"), F.sha2("text", 256).alias("hash"))


def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents replaced in the store: every fifth by its even lines, every twentieth by none."""
    root, c = activity.new_folder(spark), _chunks(spark, d)
    merges.replace(root, 0, c, c, ["corpus_id", "doc_id"], CHUNKS)
    groups = c.where("doc_id % 5 = 0").select("corpus_id", "doc_id")
    for _ in range(2):
        merges.replace(root, 1, c.where("doc_id % 20 <> 0 and order_index % 2 = 0"), groups, ["corpus_id", "doc_id"], CHUNKS)
    return merges.read(spark, root, CHUNKS).groupBy("corpus_id", "doc_id").agg(F.count("*").alias("n"), F.max("order_index").alias("last"))


def erased_tables(spark: SparkSession, d: str) -> DataFrame:
    """A corpus erased from the stored index and chunks, and one that no table holds."""
    index, chunks, c = activity.new_folder(spark), activity.new_folder(spark), _chunks(spark, d)
    docs = archive.documents(spark, d).select("corpus_id", "path", F.col("id").cast("long").alias("id"), F.col("content_hash").alias("hash"), F.lit(False).alias("deleted"))
    merges.merge(index, 0, docs, ["corpus_id", "path"], INDEX)
    merges.replace(chunks, 0, c, c, ["corpus_id", "doc_id"], CHUNKS)
    tables = {"chunks": (chunks, CHUNKS, ["corpus_id", "doc_id"]), "documents": (index, INDEX, ["corpus_id", "path"])}
    known, unknown = merges.erase(tables, "c1", 1, spark), merges.erase(tables, "nobody's", 2, spark)
    return known.unionByName(unknown.where("removed is null"))


def hashed_vector(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: counts of words in 16 buckets of their digests, of length 1."""
    out = []
    for text in texts:
        v = [0.0] * 16
        for w in text.split():
            v[hashlib.md5(w.encode()).digest()[0] % 16] += 1
        norm = math.sqrt(sum(x * x for x in v))
        out.append([x / norm for x in v] if norm else v)
    return out


def vector_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of half of the documents, then of all that are left, twice."""
    root = activity.new_folder(spark)
    texts = archive.documents(spark, d).select(F.col("id").alias("claim_id"), "text")
    for batch, part in ((0, texts.where("claim_id % 2 = 0")), (1, texts), (1, texts), (2, texts)):
        merges.backfill(root, batch, part, merges.embed_with(hashed_vector), "words-16")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    added = [spark.read.schema("hash string, _outcome string").parquet(f"{root}/data/batch={b}").where("_outcome = 'added'").select("hash", F.lit(b).alias("batch")) for b in (0, 1)]
    return merges.read(spark, root, merges.VECTORS).join(added[0].unionByName(added[1]), "hash").select("hash", "batch", F.round(norm, 6).alias("norm"))


def stream_claims(spark: SparkSession, d: str) -> DataFrame:
    """Live claims kept from the feed in three arrivals, which do not come in order."""
    folder = activity.new_folder(spark)
    v = archive.versions(spark, d)
    rows = claim_state.nested_versions(v, archive.claims(v))
    for part in range(3):
        rows.where(F.pmod(F.floor(F.col("version_number") / 3), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    claim_state.keep_live_claims(feed, folder, f"{folder}/table")
    return claim_state.live_claims(spark, f"{folder}/table")


ORACLES = {
    "synced_index": _DOCS + "select corpus_id, path, case when id % 10 = 0 then id + 1000000000 else id end id, case when id % 7 = 0 then sha256(text || '!') else content_hash end hash from docs where id % 13 <> 0",
    "sync_batches": _DOCS
    + """select cast(0 as int) as batch, 'added' as outcome, count(*) n from docs where id % 10 <> 0 union all
select 1, case when id % 10 = 0 then 'added' when id % 13 = 0 then 'deleted' when id % 7 = 0 then 'changed' else 'unchanged' end, count(*) from docs where not (id % 10 = 0 and id % 13 = 0) group by 2 union all
select 2, 'unchanged', count(*) from docs where id % 13 <> 0""",
    "stored_chunks": _DOCS + "select corpus_id, doc_id, count(*) n, cast(max(order_index) as int) as last from (select d.corpus_id, c.* from chunks c join docs d on d.id = c.doc_id) x where doc_id % 5 <> 0 or (doc_id % 20 <> 0 and order_index % 2 = 0) group by 1, 2",
    "erased_tables": _DOCS
    + """select 'documents' table_name, count(*) filter (where corpus_id = 'c1') removed, count(*) filter (where corpus_id <> 'c1') as left from docs union all
select 'chunks', count(*) filter (where doc_id % 4 = 1), count(*) filter (where doc_id % 4 <> 1) from chunks union all select 'corpus_not_found', null, null""",
    "vector_backfill": _DOCS + "select sha256(text) hash, cast(case when bool_or(id % 2 = 0) then 0 else 1 end as int) as batch, case when regexp_matches(max(text), '[^\\s]') then 1.0 else 0.0 end norm from docs where text is not null group by text",
    "stream_claims": ARCHIVE_SQL + "select corpus_id, doc_id, key, claim_id, val, version_number from c where (doc_id, version_number) in (select doc_id, max(version_number) from v group by 1)",
}
QUERIES = {name: globals()[name] for name in ORACLES}
