"""Registered queries of live-index maintenance, audits and evaluation, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import maintain
from palimpsest.plans.registry import _DOCS, ARCHIVE_SQL
from palimpsest.sources import archive
from palimpsest.sources.archive import table
from palimpsest.streaming import activity


def active_claims(spark: SparkSession, d: str) -> DataFrame:
    v = archive.versions(spark, d)
    return maintain.active_claims(v, archive.with_topic_edges(archive.claims(v)).drop("basis")).select("claim_id", "corpus_id", "key", "val")


def tombstones(spark: SparkSession, d: str) -> DataFrame:
    v = archive.versions(spark, d)
    return maintain.tombstones(v, v.where("doc_id % 5 = 0").select("doc_id").distinct())


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = archive.documents(spark, d)
    old = docs.where("id % 10 <> 0").select("path", "id", F.col("content_hash").alias("hash"))
    changed = F.when(F.col("id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content_hash"))
    return maintain.upsert(old, docs.where("id % 13 <> 0").select("path", (F.col("id") + 1_000_000_000).alias("id"), changed.alias("hash")), "path")


def erasure_report(spark: SparkSession, d: str) -> DataFrame:
    v = archive.versions(spark, d)
    docs = archive.documents(spark, d)
    return maintain.erasure_report({"versions": v, "claims": archive.claims(v), "documents": docs, "chunks": archive.line_chunks(docs)}, "c1")


def audit_unique(spark: SparkSession, d: str) -> DataFrame:
    """Over a copy that holds some claims twice."""
    c = archive.claims(archive.versions(spark, d))
    return maintain.audit_unique(c.union(c.where("val % 50 = 0")))


def validity_by_day(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    out = maintain.validity_by_day(archive.claims(archive.versions(spark, d)), days)
    return out.select(F.col("day").cast("string").alias("day"), "n_valid")


def resolve_prefixes(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "events").select(F.substring((F.col("user_id") * 7 + 100).cast("string"), 1, 3).alias("ref")).distinct()
    return maintain.resolve_prefixes(archive.claims(archive.versions(spark, d)), refs, 3)


def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Text length as a predictor of the quality label, by language."""
    rows = table(spark, d, "labels").where("quality is not null").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return maintain.confusion(rows.select("lang", (F.col("quality") == 1).alias("actual"), (F.col("n_chars") >= 400).alias("predicted")), "lang")


def event_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintain.sample_stats(table(spark, d, "events"), "event_type", "value")


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return maintain.review_sample(table(spark, d, "labels").select("quality", "doc_id"), "quality", "doc_id", 25)


def stride_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = maintain.stride_chunks(table(spark, d, "documents").select("doc_id", "text"), 512, 64)
    return out.select("doc_id", "order_index", F.sha2("chunk", 256).alias("digest"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    return maintain.statements(table(spark, d, "conversations")).select("conv_id", "turn", "replaces", "digest", "tokens")



def _feed(spark: SparkSession, d: str) -> DataFrame:
    feed = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")  # a pattern: a table may be one file
    return feed.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """The feed as a stream: events per closed day and type."""
    out = activity.drain(activity.windowed_activity(_feed(spark, d), "1 day", "2 hours"), activity.new_folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events per type in closed windows of a day, one beginning every six hours."""
    out = activity.drain(activity.windowed_activity(_feed(spark, d), "1 day", "2 hours", "6 hours"), activity.new_folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Closed sessions of each user, six hours without an event apart."""
    out = activity.drain(activity.sessions(_feed(spark, d), "user_id", "6 hours", "2 hours"), activity.new_folder(spark))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("user_id", stamp("first"), stamp("last"), "n")


_EDGES = ARCHIVE_SQL + """, cl as (select *, lag(claim_id) over w p_id, lag(doc_id) over w p_doc, lag(observed_at) over w p_at from c window w as (partition by corpus_id, key order by observed_at, claim_id)),
cx as (select * exclude (supersedes_id), case when supersedes_id is null and val % 5 = 0 and p_doc <> doc_id and p_at < observed_at then p_id else supersedes_id end supersedes_id from cl),
latest as (select * from (select *, row_number() over (partition by doc_id order by version_number desc) r from v) x where r = 1 and event <> 'DELETED')
"""
_COUNTS = "select '{n}' table_name, count(*) filter (where corpus_id = 'c1') removed, count(*) filter (where corpus_id <> 'c1') as left from {n}"
ORACLES = {
    "active_claims": _EDGES + "select claim_id, corpus_id, key, val from cx where version_id in (select version_id from latest) and claim_id not in (select supersedes_id from cx where supersedes_id is not null)",
    "tombstones": _EDGES + "select corpus_id, doc_id, version_number + 1 version_number, version_id predecessor_id, 'DELETED' event from latest where doc_id % 5 = 0",
    "upsert_documents": _DOCS + ", o as (select path, id, content_hash h from docs where id % 10 <> 0), n as (select path, id + 1000000000 id, case when id % 7 = 0 then sha256(text || '!') else content_hash end h from docs where id % 13 <> 0) select coalesce(o.path, n.path) path, coalesce(o.id, n.id) id, coalesce(n.h, o.h) hash, n.h is not null and n.h is distinct from o.h written from o full join n on o.path = n.path",
    "erasure_report": ARCHIVE_SQL + ", versions as (select corpus_id from v), claims as (select corpus_id from c), " + _DOCS.removeprefix("with ") + ", " + "r as (" + " union all ".join(_COUNTS.format(n=n) for n in ("versions", "claims", "chunks")) + " union all " + _COUNTS.format(n="docs").replace("'docs'", "'documents'") + ") select * from r",
    "audit_unique": ARCHIVE_SQL + "select version_id, key, count(*) n from (select version_id, key from c1 union all select version_id, key from c1 where val % 50 = 0) x group by all having count(*) > 1",
    "validity_by_day": ARCHIVE_SQL + ", days as (select distinct cast(ts as date) as day from events) select cast(days.day as varchar) as day, count(c.claim_id) n_valid from days left join c on cast(c.valid_from as date) <= days.day and (c.valid_until is null or days.day < cast(c.valid_until as date)) group by days.day",
    "resolve_prefixes": ARCHIVE_SQL + ", refs as (select distinct left(cast(user_id * 7 + 100 as varchar), 3) as ref from events), h as (select left(claim_id, 3) as ref, count(*) n, min(claim_id) m from c group by 1) select refs.ref, coalesce(n, 0) n, case when n = 1 then m end claim_id, case when n is null then 'missing' when n = 1 then 'resolved' else 'ambiguous' end outcome from refs left join h on h.ref = refs.ref",
    "label_confusion": "with x as (select lang, quality = 1 a, n_chars >= 400 p from labels join documents using (doc_id) where quality is not null), m as (select lang, count(*) filter (where a and p) tp, count(*) filter (where not a and p) fp, count(*) filter (where a and not p) fn, count(*) filter (where not a and not p) tn from x group by 1) select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) recall, round(tn / nullif(tn + fp, 0), 6) specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1 from m",
    "event_stats": "select event_type, count(*) n, round(avg(value), 4) mean, round(median(value), 4) median, round(coalesce(stddev_samp(value), 0), 4) stdev from events group by 1",
    "review_sample": "select * from (select quality, doc_id, row_number() over (partition by quality order by doc_id) as position from labels) where position <= 25",
    "stride_chunks": "select doc_id, order_index, sha256(substring(text, order_index * 448 + 1, 512)) digest from (select doc_id, text, cast(unnest(range(0, cast(greatest(0, ceil((length(text) - 512) / 448.0)) as bigint) + 1)) as int) order_index from documents where length(text) > 0)",
    "statements": "with s as (select conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^[# ]+', '')) t from conversations where role = 'user') select conv_id, turn, lag(turn) over (partition by conv_id order by turn) replaces, sha256(t) digest, greatest(1, length(t) // 4) tokens from s where t <> ''",
    "stream_activity": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) n from events group by all having date_trunc('day', min(ts)) + interval 1 day <= (select max(ts) from events) - interval 2 hours",
    "stream_sliding": "with w as (select event_type, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') - i * interval 6 hours s from events, range(4) r(i)) select strftime(s, '%Y-%m-%d %H') as start, event_type, count(*) n from w where s + interval 1 day <= (select max(ts) from events) - interval 2 hours group by s, event_type",
    "stream_sessions": "with o as (select user_id, ts, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval 6 hours, true) b from events), g as (select *, sum(b::int) over (partition by user_id order by ts rows unbounded preceding) s from o) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last, count(*) n from g group by user_id, s having max(ts) + interval 6 hours <= (select max(ts) from events) - interval 2 hours",
}
QUERIES = {name: globals()[name] for name in ORACLES}
