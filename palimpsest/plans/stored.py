"""Registered queries of the stored archive, logs, question sets and arrivals, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import logs, state, stored
from palimpsest.plans.matching import pick, pick_sql
from palimpsest.plans.registry import _DOCS, ARCHIVE_SQL, EARLY, NOW
from palimpsest.sources import archive
from palimpsest.sources.archive import table
from palimpsest.streaming import activity, arrivals

BOTH = ARCHIVE_SQL + ", " + _DOCS.removeprefix("with ")


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Versions and claims written in three batches; the last one never got its mark."""
    root = activity.new_folder(spark)
    v = durable(archive.versions(spark, d))
    c = archive.claims(v)
    seen = F.col("observed_at")
    for batch, part in enumerate((seen <= state.instant(EARLY), (seen > state.instant(EARLY)) & (seen <= state.instant(NOW)), seen > state.instant(NOW))):
        stored.append(root, batch, {"versions": v.where(part), "claims": c.where(part)}, commit=batch < 2)
    return stored.load(spark, root, "versions"), stored.load(spark, root, "claims")


def stored_archive(spark: SparkSession, d: str) -> DataFrame:
    v, c = _stored(spark, d)
    counts = c.groupBy("version_id").agg(F.count("*").alias("n_claims"), F.max("claim_id").alias("last_claim"))
    return v.join(counts, "version_id", "left").select("version_id", "corpus_id", "version_number", "event", "batch", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), "last_claim")


def nested_archive(spark: SparkSession, d: str) -> DataFrame:
    v = archive.versions(spark, d)
    out = stored.load_nested(v, archive.claims(v))
    return out.select("version_id", "path", F.array_join(F.transform("claims", lambda x: x["claim_id"]), ",").alias("claim_ids"))


def rehydrated(spark: SparkSession, d: str) -> DataFrame:
    """The archive's latest contents over a live index that holds some of its paths and all documents."""
    v = archive.versions(spark, d)
    latest = state.latest_versions(v).select("version_id").join(v, "version_id").select("corpus_id", "path", "event", F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("fp")).alias("content"))
    old = v.where("version_number = 1 and doc_id % 2 = 0").select("corpus_id", "path", F.lit("old").alias("content"))
    live = archive.documents(spark, d).select("corpus_id", "path", F.col("text").alias("content")).unionByName(old)
    return stored.rehydrate(latest, live).select("corpus_id", "path", "origin", F.sha2("content", 256).alias("digest"))


def rewritten_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth document has new chunks, every tenth none."""
    docs = archive.documents(spark, d)
    chunks = archive.line_chunks(docs)
    fresh = chunks.where("doc_id % 10 = 5").withColumn("text", F.concat("text", F.lit("!")))
    out = stored.replace_chunks(chunks, fresh, docs.where("id % 5 = 0").select("corpus_id", F.col("id").alias("doc_id")))
    return out.select("doc_id", "order_index", F.sha2("text", 256).alias("digest"))


def vector_work(spark: SparkSession, d: str) -> DataFrame:
    c = archive.claims(archive.versions(spark, d)).select("claim_id", F.concat(F.substring_index("key", ".", 1), F.lit(" is "), "val").alias("text"), "val")
    return stored.vector_work(c, c.where("val % 3 = 0").select(F.sha2("text", 256).alias("hash")).distinct())


def reset_counts(spark: SparkSession, d: str) -> DataFrame:
    v, docs = archive.versions(spark, d), archive.documents(spark, d)
    tables = {"corpora": docs.select("corpus_id").distinct(), "versions": v, "claims": archive.claims(v), "documents": docs}
    left = stored.reset(tables, "c1")
    one = lambda t, name: t.groupBy().agg(F.lit(name).alias("table_name"), F.count_if(F.col("corpus_id") == "c1").alias("of_corpus"), F.count("*").alias("n"))
    out = [one(t, name) for name, t in left.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def staged(spark: SparkSession, d: str) -> DataFrame:
    """Users' days as stages of a week; a path is deleted in the stage in which its user erred."""
    e = table(spark, d, "events").select(F.concat(F.lit("u/"), "user_id").alias("path"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("stage"), "event_id", "event_type")
    payload = e.where("event_type <> 'error'").groupBy("path", "stage").agg(F.max("event_id").cast("string").alias("content"))
    deleted = e.where("event_type = 'error' and event_id % 2 = 0").select("path", "stage").distinct()
    return stored.stages(payload, deleted)


def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The event log as JSON lines, every seventeenth cut in two, read back."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    lines = logs.log_lines(e, "event_id", "user_id", "event_type", "value").withColumn("id", F.get_json_object("value", "$.event_id").cast("long"))
    cut = F.when(F.col("id") % 17 == 0, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value"))
    return logs.read_log(lines.select(cut.alias("value")), "event_id long, user_id long, event_type string, value double")


GIVEN = ("relevant", "compatible", "accept", "maybe", None, "open", "resolved", "unknown", "current", "sufficient", "Relevant")


def label_checks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    fields = [pick(GIVEN, F.floor(n / (i + 1)) + i).alias(f) for i, f in enumerate(logs.LABEL_FIELDS)]
    return logs.check_labels(table(spark, d, "events").select(n, *fields)).select("event_id", "field")


def question_checks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    q = table(spark, d, "documents").select(n.alias("question_id"), F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit("about "), n % 400, F.lit(" of "), "source")).alias("query"), F.when(n % 4 == 0, F.array(F.lit("a"))).when(n % 4 == 1, F.array().cast("array<string>")).alias("expected"), (n % 6 == 1).alias("expect_empty"))
    return logs.check_questions(q).select("question_id", "reason")


def authored_checks(spark: SparkSession, d: str) -> DataFrame:
    """Two claims a document, quoted from its first line, spoilt by its number."""
    n = F.col("doc_id") % 12
    docs = table(spark, d, "documents").withColumn("q", F.trim(F.substring_index("text", "\n", 1)))
    one = F.struct(F.lit("k1").alias("key"), F.when(n != 1, "v").alias("value"), F.when(n == 2, " ").when(n == 3, "not in the text at all").otherwise(F.col("q")).alias("claim"),
        F.when(n == 4, F.array().cast("array<string>")).when(n == 5, F.array("q", "q")).when(n == 6, F.array(F.concat("q", F.lit("#~")))).when(n == 7, F.lit(None)).otherwise(F.array("q")).alias("evidence"),
        F.lit("2024-02-01").alias("valid_from"), F.when(n == 8, "2024-01-01").otherwise("2024-02-01").alias("valid_until"))
    two = F.struct(F.when(n == 9, "k1").otherwise("k2").alias("key"), F.lit("v").alias("value"), F.col("q").alias("claim"), F.array("q").alias("evidence"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_until"))
    claims = F.when(n == 10, "{").when(n == 11, F.lit(None)).otherwise(F.to_json(F.array(one, two)))
    return logs.check_authored(docs.select("doc_id", claims.alias("claims"), F.array("text").alias("chunks")))


DECLARED = ("Supersedes: adr/0001.md", "- **Superseded by**: [new](adr/0002.md)", "supersedes: none", "It supersedes: x", "superseded-by: `a.b`", "Supersedes: adr/0001.md", "* SUPERSEDES : <x/y.md>", "Supersedes:")


def declarations(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), pick(DECLARED, F.col("event_id")).alias("line"))
    return logs.declarations(lines)


def eligible_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = archive.documents(spark, d).select(F.col("id").alias("doc_id"))
    lines = archive.line_chunks(archive.documents(spark, d)).where("text like '- %'").select("doc_id")
    return logs.eligible(docs, lines, docs.where("doc_id % 10 = 3"), archive.versions(spark, d))


def _feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path)


def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """The events in three arrivals; those twenty days behind what came before are set aside."""
    folder = activity.new_folder(spark)
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for i in range(3):
        e.where(F.col("event_id") % 3 == i).write.parquet(f"{folder}/in/arrival={i}")
        arrivals.split_late(_feed(spark, f"{folder}/in").select("event_id", "ts"), folder, "20 days")
    read = lambda name: spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").select("event_id", F.col("batch").cast("int").alias("arrival"), F.lit(name).alias("outcome"))
    return read("on_time").union(read("late"))


def stream_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The versions in three arrivals, a snapshot after each."""
    folder = activity.new_folder(spark)
    v = archive.versions(spark, d).select("version_id", "corpus_id", F.col("observed_at").cast("timestamp").alias("observed_at"))
    for i, (low, high) in enumerate((("1970-01-01 00:00:00", EARLY), (EARLY, NOW), (NOW, "9000-01-01 00:00:00"))):
        v.where((F.col("observed_at") > state.instant(low)) & (F.col("observed_at") <= state.instant(high))).write.parquet(f"{folder}/in/arrival={i}")
        arrivals.seal_snapshots(_feed(spark, f"{folder}/in").select("version_id", "corpus_id", "observed_at"), folder)
    sealed = spark.read.option("basePath", f"{folder}/sealed").parquet(f"{folder}/sealed")
    return sealed.select(F.col("batch").cast("int").alias("snapshot"), "corpus_id", "n", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss").alias("cutoff"))


def stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as calls; a signup or purchase judges the call before it in the numbering, if it came within five days."""
    path = f"{d}/events.parquet"
    feed = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    calls = feed.where("event_type = 'click'").select(F.col("event_id").alias("query_id"), "ts", pick(("confident", "ambiguous", "abstained"), F.col("event_id")).alias("match_status"))
    verdicts = feed.where("event_type in ('signup', 'purchase')").select((F.col("event_id") - 1).alias("query_id"), F.when(F.col("event_type") == "signup", "right").otherwise("wrong").alias("verdict"), F.col("ts").alias("judged_at"))
    return arrivals.verdict_counts(calls, verdicts, activity.new_folder(spark), "5 days")


_LAST = "(select * from (select *, row_number() over (partition by doc_id order by version_number desc) r from v) x where r = 1)"
_GIVEN = ", ".join(f"{pick_sql(GIVEN, f'event_id // {i + 1} + {i}')} {f}" for i, f in enumerate(logs.LABEL_FIELDS))
_WRONG = " ".join(f"when {f} is null or {f} not in ({', '.join(repr(x) for x in logs.LABELS)}) then '{f}'" for f in logs.LABEL_FIELDS)
ORACLES = {
    "stored_archive": ARCHIVE_SQL + f"select v.version_id, v.corpus_id, v.version_number, event, case when v.observed_at <= timestamp '{EARLY}' then 0 else 1 end batch, count(claim_id) n_claims, max(claim_id) last_claim from v left join c on c.version_id = v.version_id where v.observed_at <= timestamp '{NOW}' group by all",
    "nested_archive": ARCHIVE_SQL + "select v.version_id, v.path, string_agg(claim_id, ',' order by key) claim_ids from v left join c on c.version_id = v.version_id group by all",
    "rehydrated": BOTH + f""", a as (select corpus_id, path, case when event = 'DELETED' or doc_id % 7 = 0 then null else fp end content from {_LAST} y),
live as (select corpus_id, path, text as content from docs union all select corpus_id, path, 'old' from v where version_number = 1 and doc_id % 2 = 0)
select corpus_id, path, case when content is null then 'removed' else 'rebuilt' end origin, sha256(content) digest from a union all select corpus_id, path, 'live_only', sha256(content) from live where (corpus_id, path) not in (select (corpus_id, path) from a)""",
    "rewritten_chunks": _DOCS + "select doc_id, order_index, sha256(case when doc_id % 5 = 0 then text || '!' else text end) digest from chunks where doc_id % 10 <> 0",
    "vector_work": ARCHIVE_SQL + "select sha256(t) hash, min(claim_id) first_id, count(*) n from (select claim_id, val, split_part(key, '.', 1) || ' is ' || val t from c) x group by t having max(val) % 3 <> 0",
    "reset_counts": BOTH + "select 'corpora' table_name, count(*) filter (where corpus_id = 'c1') of_corpus, count(*) n from (select distinct corpus_id from docs) union all select 'versions', 0, count(*) from v where corpus_id <> 'c1' union all select 'claims', 0, count(*) from c where corpus_id <> 'c1' union all select 'documents', 0, count(*) from docs where corpus_id <> 'c1'",
    "staged": """with e as (select 'u/' || user_id path, cast(floor((day(ts) - 1) / 7) as int) stage, * from events), m as (select path, stage, max(event_id) filter (where event_type <> 'error') content, count(*) filter (where event_type = 'error' and event_id % 2 = 0) > 0 gone from e group by all having content is not null or gone),
s as (select distinct stage from m), p as (select distinct path from m), z as (select p.path, s.stage, (select max(stage) from m where m.path = p.path and m.stage <= s.stage) last from p, s)
select z.stage, z.path, cast(content as varchar) as content from z join m on m.path = z.path and m.stage = z.last where not gone""",
    "log_round_trip": "select event_id, user_id, event_type, value from events where event_id % 17 <> 0",
    "label_checks": f"select event_id, case {_WRONG} end field from (select event_id, {_GIVEN} from events)",
    "question_checks": "with q as (select doc_id id, case when doc_id % 9 = 0 then ' ' else 'about ' || (doc_id % 400) || ' of ' || source end query, case doc_id % 4 when 0 then 1 else 0 end size, doc_id % 6 = 1 none from documents) select id question_id, case when trim(coalesce(query, '')) = '' then 'query_missing' when min(id) over (partition by query) < id then 'duplicate_query' when none and size > 0 then 'expected_with_expect_empty' when not none and size = 0 then 'expected_missing' end reason from q",
    "authored_checks": "select doc_id, case when doc_id % 12 in (10, 11) then 0 else 2 end n_claims, case when doc_id % 12 = 10 then 'unreadable' when doc_id % 12 = 9 then 'key_repeated' when doc_id % 12 = 1 then 'value_missing' when doc_id % 12 <> 11 and trim(split_part(coalesce(text, ''), chr(10), 1)) = '' then 'key_or_claim_missing' else case doc_id % 12 when 2 then 'key_or_claim_missing' when 3 then 'claim_not_in_chunk' when 4 then 'evidence_missing' when 5 then 'evidence_repeated' when 6 then 'evidence_not_in_chunk' when 7 then 'evidence_missing' when 8 then 'window_reversed' end end reason from documents",
    "declarations": "select user_id doc_id, case event_id % 8 when 1 then 'superseded_by' when 4 then 'superseded_by' else 'supersedes' end relation, case event_id % 8 when 0 then 'adr/0001.md' when 5 then 'adr/0001.md' when 1 then 'adr/0002.md' when 4 then 'a.b' else 'x/y.md' end reference, min(event_id) line_no from events where event_id % 8 in (0, 1, 4, 5, 6) group by all",
    "eligible_documents": BOTH + "select id doc_id from docs where id % 10 = 3 or id in (select doc_id from v) or id in (select doc_id from chunks where text like '- %')",
    "stream_late": "with b as (select event_id % 3 i, max(ts) newest from events group by 1), r as (select event_id, cast(event_id % 3 as int) arrival, ts < (select max(newest) from b where b.i < event_id % 3) - interval 20 days late from events) select event_id, arrival, case when coalesce(late, false) then 'late' else 'on_time' end outcome from r",
    "stream_snapshots": ARCHIVE_SQL + f", cuts(snapshot, upto) as (values (0, timestamp '{EARLY}'), (1, timestamp '{NOW}'), (2, timestamp '9000-01-01')) select cast(snapshot as int) snapshot, corpus_id, count(*) n, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') cutoff from v join cuts on observed_at <= upto group by all",
    "stream_verdicts": "select ['confident','ambiguous','abstained'][c.event_id % 3 + 1] match_status, case j.event_type when 'signup' then 'right' else 'wrong' end verdict, count(*) n from events c join events j on j.event_id = c.event_id + 1 where c.event_type = 'click' and j.event_type in ('signup', 'purchase') and abs(epoch(j.ts) - epoch(c.ts)) <= 432000 group by all",
}
QUERIES = {name: globals()[name] for name in ORACLES}
