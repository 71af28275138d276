"""Registered queries of the archive engine, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import retrieve, state
from palimpsest.sources import archive
from palimpsest.sources.archive import table

NOW, EARLY = "2024-01-20 00:00:00", "2024-01-10 00:00:00"
ARCHIVE_SQL = """with fx_ev as (select user_id, event_id, ts, event_type, cast(ts as date) d, cast(replace(replace(props,'{"k": ',''),'}','') as int) k from events),
fx_writes as (select user_id, d, max(ts) observed_at, max(event_id) version_id, max_by(event_type, ts) last_type,
 max_by(k, ts) filter (where event_type='view') v_view, max_by(k, ts) filter (where event_type='click') v_click,
 max_by(k, ts) filter (where event_type='signup') v_signup, max_by(k, ts) filter (where event_type='purchase') v_purchase from fx_ev group by user_id, d),
fx_fp as (select *, case when last_type='error' then 'DELETED' else concat(coalesce(cast(v_view as varchar),'-'),'|',coalesce(cast(v_click as varchar),'-'),'|',coalesce(cast(v_signup as varchar),'-'),'|',coalesce(cast(v_purchase as varchar),'-')) end fp from fx_writes),
fx_live as (select * from (select *, sum(case when fp='DELETED' then 0 else 1 end) over (partition by user_id order by observed_at, version_id rows between unbounded preceding and current row) seen from fx_fp) t where seen > 0),
fx_kept as (select * from (select *, lag(fp) over (partition by user_id order by observed_at, version_id) prev_fp from fx_live) t where prev_fp is null or prev_fp <> fp),
v as (select concat('c', cast(user_id % 4 as varchar)) corpus_id, user_id doc_id, concat('users/', cast(user_id % 7 as varchar), '/', cast(user_id as varchar), '.md') path, version_id,
 row_number() over (partition by user_id order by observed_at, version_id) version_number, lag(version_id) over (partition by user_id order by observed_at, version_id) predecessor_id,
 case when fp='DELETED' then 'DELETED' when prev_fp is null then 'NEW' when prev_fp='DELETED' then 'RESTORED' else 'MODIFIED' end event, observed_at, fp, d, v_view, v_click, v_signup, v_purchase from fx_kept),
c0 as (select *, 'view' key0, v_view k from v where event<>'DELETED' and v_view is not null union all select *, 'click', v_click from v where event<>'DELETED' and v_click is not null
 union all select *, 'signup', v_signup from v where event<>'DELETED' and v_signup is not null union all select *, 'purchase', v_purchase from v where event<>'DELETED' and v_purchase is not null),
c1 as (select concat(cast(version_id as varchar), ':', key0) claim_id, corpus_id, doc_id, path, version_id, version_number, observed_at, concat(key0, '.', cast(cast(floor(doc_id / 8) as int) as varchar)) key, k val,
 concat(key0, ' of user ', cast(doc_id as varchar), ' is ', cast(k as varchar)) claim, cast(d as timestamp) valid_from, case when k % 2 = 0 then cast(d as timestamp) + interval 7 days end valid_until from c0),
c as (select a.*, p.claim_id supersedes_id from c1 a left join c1 p on p.doc_id=a.doc_id and p.key=a.key and p.version_number=a.version_number-1)
"""
EDGES_SQL = ARCHIVE_SQL + """, cl as (select *, lag(claim_id) over w p_id, lag(doc_id) over w p_doc, lag(observed_at) over w p_at from c window w as (partition by corpus_id, key order by observed_at, claim_id)),
cx as (select * exclude (supersedes_id, p_id, p_doc, p_at), case when supersedes_id is null and val % 5 = 0 and p_doc <> doc_id and p_at < observed_at then p_id else supersedes_id end supersedes_id,
 case when supersedes_id is null and val % 5 = 0 and p_doc <> doc_id and p_at < observed_at then 'topic_key' when supersedes_id is not null then 'same_document_key' end basis from cl)
"""


def status_sql(as_of: str, base: str = ARCHIVE_SQL) -> str:
    t = f"timestamp '{as_of}'"
    return base + f""", vs as (select * from v where observed_at <= {t}), cs as (select * from c where observed_at <= {t}),
live as (select version_id from (select *, row_number() over (partition by doc_id order by version_number desc) r from vs) x where r = 1 and event <> 'DELETED'),
s0 as (select cs.*, case when claim_id in (select supersedes_id from cs where supersedes_id is not null) then 'SUPERSEDED' when version_id not in (select version_id from live) or {t} < valid_from or {t} >= valid_until then 'UNCERTAIN' else 'CURRENT' end st from cs),
s as (select s0.*, case when st = 'CURRENT' and (select count(distinct val) from s0 o where o.corpus_id = s0.corpus_id and o.key = s0.key and o.st = 'CURRENT') > 1 then 'CONFLICTING' else st end status from s0)
"""


def _vc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = archive.versions(spark, d)
    return v, archive.claims(v)


def _resolved(spark: SparkSession, d: str, at: str = NOW) -> DataFrame:
    return state.resolve(*_vc(spark, d), at)


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return archive.versions(spark, d).select("corpus_id", "doc_id", "path", "version_id", "version_number", "predecessor_id", "event", "fp")


def claim_edges(spark: SparkSession, d: str) -> DataFrame:
    return archive.with_topic_edges(_vc(spark, d)[1]).select("claim_id", "key", "val", "supersedes_id", "basis")


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_versions(archive.versions(spark, d))


def resolve(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("claim_id", "corpus_id", "key", "val", "status")


def current_claims(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).where("status = 'CURRENT'").select("claim_id", "corpus_id", "path", "key", "val", "claim")


def as_of_counts(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, EARLY).groupBy("corpus_id", "status").agg(F.count("*").alias("n"))


def current_under_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).where((F.col("status") == "CURRENT") & state.under_prefix("path", ["users/3", "users/5/"])).select("claim_id", "path")


def history(spark: SparkSession, d: str) -> DataFrame:
    v, c = _vc(spark, d)
    return state.history(state.resolve(v, c, NOW), v, NOW)


def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    return state.conflict_groups(_resolved(spark, d))


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return state.conflict_pairs(_resolved(spark, d))


def conflict_sides(spark: SparkSession, d: str) -> DataFrame:
    return state.conflict_sides(_resolved(spark, d))


def withheld_counts(spark: SparkSession, d: str) -> DataFrame:
    info = F.element_at(F.map_from_arrays(F.array(*map(F.lit, (0, 1, 2))), F.array(*map(F.lit, ("draft", "rejected", "superseded")))), F.col("val") % 10)
    return _resolved(spark, d).where("status = 'CURRENT'").withColumn("info_state", F.coalesce(info, F.lit("approved"))).groupBy("info_state").agg(F.countDistinct("claim_id").alias("n"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    return state.changes(*_vc(spark, d))


def feed_page(spark: SparkSession, d: str) -> DataFrame:
    return state.feed_page(archive.versions(spark, d), (EARLY, 0), 50)


def snapshot_members(spark: SparkSession, d: str) -> DataFrame:
    cuts = [(t, state.instant(t)) for t in (EARLY, NOW, "2024-01-31 00:00:00")]
    v = archive.versions(spark, d)
    hit = F.explode(F.array_compact(F.array(*[F.when(F.col("observed_at") <= at, F.lit(t)) for t, at in cuts])))
    return v.select("corpus_id", hit.alias("cutoff")).groupBy("corpus_id", "cutoff").agg(F.count("*").alias("n_versions"))


def replay(spark: SparkSession, d: str) -> DataFrame:
    v, c = _vc(spark, d)
    members = v.where(F.col("observed_at") <= state.instant(EARLY)).select("version_id")
    replayed = state.resolve(v.join(members, "version_id", "left_semi"), c.join(members, "version_id", "left_semi"), EARLY)
    return replayed.select("claim_id", "status")


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return state.snapshot_diff(*_vc(spark, d), EARLY, NOW)


def drift(spark: SparkSession, d: str) -> DataFrame:
    return state.drift(*_vc(spark, d), NOW)


def in_force(spark: SparkSession, d: str) -> DataFrame:
    return state.in_force(_vc(spark, d)[1], EARLY, NOW)


def lineage_chains(spark: SparkSession, d: str) -> DataFrame:
    return state.lineage(archive.with_topic_edges(_vc(spark, d)[1]))


def audit_predecessors(spark: SparkSession, d: str) -> DataFrame:
    return state.audit_predecessors(archive.versions(spark, d))


def audit_edges(spark: SparkSession, d: str) -> DataFrame:
    return state.audit_edges(archive.with_topic_edges(_vc(spark, d)[1]))


def audit_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Over a copy in which the offsets of some rows are wrong."""
    wrong = (F.col("val") % 50 == 0).cast("int")
    e = archive.evidence(_vc(spark, d)[1])
    return state.audit_evidence(e.withColumns({"start_offset": F.col("start_offset") + wrong, "end_offset": F.col("end_offset") + wrong}))


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return archive.line_chunks(archive.documents(spark, d)).groupBy("corpus_id", "doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.max("order_index").alias("last_index"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = archive.documents(spark, d)
    chunks = archive.line_chunks(docs).groupBy("corpus_id").agg(F.count("*").alias("n_chunks"))
    return docs.groupBy("corpus_id").agg(F.count("*").alias("n_documents"), F.countDistinct("content_hash").alias("n_contents"), F.max("date").cast("string").alias("last_date")).join(chunks, "corpus_id")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    docs = archive.documents(spark, d).where(F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("src3"))))
    return docs.orderBy(F.desc_nulls_last("date"), "id").limit(100).select("id", F.col("date").cast("string").alias("date"), "document_type")


def sync_outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = archive.documents(spark, d)
    old = docs.where("id % 10 <> 0").select("path", F.col("content_hash").alias("hash"))
    new = docs.where("id % 13 <> 0").select("path", F.when(F.col("id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content_hash")).alias("hash"))
    return retrieve.reconcile(new, old)


def embed_work(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts to embed, each with the number of documents that share it."""
    return archive.documents(spark, d).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    terms = F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9]+)"), 1)
    return retrieve.document_frequency(table(spark, d, "benchmark").select(terms.alias("terms")))


def text_availability(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.containing(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def _labelled(spark: SparkSession, d: str, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relevant to a query is what has its label."""
    e = table(spark, d, "embeddings")
    return retrieve.labelled(ranked, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label"), e.select(F.col("vec_id").alias("item_id"), "label"))


def knn(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.top_k(*_vectors(spark, d), 5)


def knn_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked = durable(retrieve.top_k(*_vectors(spark, d), 10))
    relevant, total = _labelled(spark, d, ranked)
    return retrieve.retrieval_metrics(ranked, relevant, 10, total)


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return retrieve.latency_percentile(e.select(F.col("event_type").alias("operation"), F.col("event_id").alias("query_id"), F.col("value").alias("latency_ms")))


def feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    log = table(spark, d, "events").select(k.alias("k")).where("k % 5 = 0")
    pick = lambda names, x: F.element_at(F.array(*map(F.lit, names)), x + 1)
    return log.groupBy(pick(("right", "wrong", "abstained_wrongly"), F.col("k") % 7 % 3).alias("verdict"), pick(("confident", "ambiguous", "abstained"), F.col("k") % 3).alias("match_status")).agg(F.count("*").alias("n"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    v = archive.versions(spark, d)
    return v.groupBy("corpus_id", "event", F.date_format(F.window("observed_at", "1 day")["start"], "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


_LATEST = "select * from (select *, row_number() over (partition by doc_id order by version_number desc) r from v where observed_at <= timestamp '{t}') x where r = 1 and event <> 'DELETED'"
_DOCS = """with docs as (select 'c' || (doc_id % 4) corpus_id, doc_id id, source || '/' || doc_id || '.txt' path, [lang, source] tags, case when doc_id % 11 <> 0 then date '2024-01-01' + cast(doc_id % 365 as int) end date,
 ['kaggle','project','note','paper'][doc_id % 4 + 1] document_type, sha256(text) content_hash, text from documents),
chunks as (select corpus_id, id doc_id, u.i - 1 order_index, u.t as text from (select corpus_id, id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'t': x, 'i': i})) u from docs) where trim(u.t) <> '')
"""
_KNN = """with s as (select q.vec_id query_id, i.vec_id item_id, round(list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double))), 6) score, q.label = i.label hit from embeddings q, embeddings i where q.vec_id % 50 = 0 and i.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)
"""
ORACLES = {
    "lifecycle": ARCHIVE_SQL + "select corpus_id, doc_id, path, version_id, version_number, predecessor_id, event, fp from v",
    "claim_edges": EDGES_SQL + "select claim_id, key, val, supersedes_id, basis from cx",
    "latest_version": ARCHIVE_SQL + "select corpus_id, doc_id, version_number, version_id, event from (select *, row_number() over (partition by doc_id order by version_number desc) r from v) where r = 1",
    "resolve": status_sql(NOW) + "select claim_id, corpus_id, key, val, status from s",
    "current_claims": status_sql(NOW) + "select claim_id, corpus_id, path, key, val, claim from s where status = 'CURRENT'",
    "as_of_counts": status_sql(EARLY) + "select corpus_id, status, count(*) n from s group by all",
    "current_under_prefix": status_sql(NOW) + "select claim_id, path from s where status = 'CURRENT' and (path like 'users/3/%' or path like 'users/5/%')",
    "history": status_sql(NOW) + "select claim_id, status from s where status = 'SUPERSEDED' or version_id not in (select version_id from live)",
    "conflict_groups": status_sql(NOW) + "select corpus_id, key, count(distinct val) n_values, count(*) n_claims from s where status = 'CONFLICTING' group by all",
    "conflict_sides": status_sql(NOW) + "select claim_id, min(claim_id) over (partition by corpus_id, key, val) side, (select count(distinct val) from s o where o.corpus_id = s.corpus_id and o.key = s.key and o.status = 'CONFLICTING') n_sides from s where status = 'CONFLICTING'",
    "conflict_pairs": status_sql(NOW) + "select a.corpus_id, a.key, a.claim_id left_id, b.claim_id right_id from s a join s b on a.corpus_id = b.corpus_id and a.key = b.key and a.claim_id < b.claim_id and a.doc_id <> b.doc_id and a.val <> b.val where a.status = 'CONFLICTING' and b.status = 'CONFLICTING'",
    "withheld_counts": status_sql(NOW) + "select case val % 10 when 0 then 'draft' when 1 then 'rejected' when 2 then 'superseded' else 'approved' end info_state, count(distinct claim_id) n from s where status = 'CURRENT' group by all",
    "changes": ARCHIVE_SQL + ", f as (select version_id, string_agg(key || '=' || val, ',' order by key) facts from c group by 1) select v.version_id, v.doc_id, v.event, case when event in ('DELETED','RESTORED') then 'LIFECYCLE' when event = 'MODIFIED' then 'DOCUMENT_MODIFIED' else 'NEW' end kind, b.facts is distinct from f.facts memory_changed from v left join f on f.version_id = v.version_id left join f b on b.version_id = v.predecessor_id",
    "feed_page": ARCHIVE_SQL + f", p as (select *, row_number() over (order by observed_at, version_id) as position from v where (observed_at, version_id) > (timestamp '{EARLY}', 0)) select position, version_id, event, (select max(position) from p) > 50 has_more from p where position <= 50",
    "snapshot_members": ARCHIVE_SQL + f"select corpus_id, t cutoff, count(*) n_versions from v, (values ('{EARLY}'), ('{NOW}'), ('2024-01-31 00:00:00')) x(t) where observed_at <= cast(t as timestamp) group by all",
    "replay": status_sql(EARLY) + "select claim_id, status from s",
    "snapshot_diff": ARCHIVE_SQL + f", a as (select doc_id, key, val from c where version_id in (select version_id from ({_LATEST.format(t=EARLY)}))), b as (select doc_id, key, val from c where version_id in (select version_id from ({_LATEST.format(t=NOW)}))) select coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.key, b.key) key, case when a.val is null then 'ADDED' when b.val is null then 'REMOVED' else 'MODIFIED' end change, a.val old, b.val new from a full join b on a.doc_id = b.doc_id and a.key = b.key where a.val is distinct from b.val",
    "drift": ARCHIVE_SQL + f", o as (select * from c where observed_at <= timestamp '{NOW}'), n as (select * from c where observed_at > timestamp '{NOW}') select claim_id, 'new' drift from n where not exists (select 1 from o where o.corpus_id = n.corpus_id and o.key = n.key and lower(o.claim) = lower(n.claim)) union all select claim_id, 'superseded' from o where claim_id in (select supersedes_id from n) union all select claim_id, 'retired' from c where version_id in (select predecessor_id from v where event = 'DELETED' and observed_at > timestamp '{NOW}')",
    "in_force": ARCHIVE_SQL + f", f as (select *, valid_from <= timestamp '{EARLY}' and (valid_until is null or timestamp '{EARLY}' < valid_until) inside from c where observed_at <= timestamp '{NOW}') select corpus_id, key, claim_id, val, inside from (select *, row_number() over (partition by corpus_id, key order by inside desc, observed_at desc, claim_id desc) r from f) where r = 1",
    "lineage_chains": EDGES_SQL.replace("with fx_ev", "with recursive fx_ev", 1) + ", up as (select claim_id, claim_id chain_id, supersedes_id nxt from cx union all select u.claim_id, x.claim_id, x.supersedes_id from up u join cx x on x.claim_id = u.nxt) select claim_id, chain_id from up where nxt is null",
    "audit_predecessors": ARCHIVE_SQL + "select b.version_id, b.event from v b left join v a on a.version_id = b.predecessor_id where case when b.version_number = 1 then b.event <> 'NEW' or b.predecessor_id is not null else a.version_number <> b.version_number - 1 or a.observed_at >= b.observed_at or (a.event = 'DELETED') <> (b.event = 'RESTORED') end",
    "audit_edges": EDGES_SQL + "select a.claim_id, a.supersedes_id from cx a left join cx b on b.claim_id = a.supersedes_id where a.supersedes_id is not null and (b.claim_id is null or b.corpus_id <> a.corpus_id or b.key <> a.key or b.observed_at >= a.observed_at)",
    "audit_evidence": ARCHIVE_SQL + ", ch as (select version_id, string_agg(claim, chr(10) order by key) chunk from c group by 1), e as (select claim_id, claim quote, chunk, val, strpos(chunk, claim) - 1 + case when val % 50 = 0 then 1 else 0 end start_offset from c join ch using (version_id)) select claim_id, start_offset, start_offset + length(quote) end_offset from e where substring(chunk, start_offset + 1, length(quote)) <> quote",
    "line_chunks": _DOCS + "select corpus_id, doc_id, count(*) n_chunks, cast(sum(length(text)) as bigint) n_chars, max(order_index) last_index from chunks group by all",
    "corpus_stats": _DOCS + "select d.*, k.n_chunks from (select corpus_id, count(*) n_documents, count(distinct content_hash) n_contents, cast(max(date) as varchar) last_date from docs group by 1) d join (select corpus_id, count(*) n_chunks from chunks group by 1) k using (corpus_id)",
    "timeline": _DOCS + "select id, cast(date as varchar) date, document_type from docs where list_has_any(tags, ['fr', 'src3']) order by docs.date desc nulls last, id limit 100",
    "sync_outcomes": _DOCS + ", o as (select path, content_hash h from docs where id % 10 <> 0), n as (select path, case when id % 7 = 0 then sha256(text || '!') else content_hash end h from docs where id % 13 <> 0) select coalesce(o.path, n.path) path, case when o.h is null then 'added' when n.h is null then 'deleted' when o.h <> n.h then 'changed' else 'unchanged' end outcome from o full join n on o.path = n.path",
    "embed_work": _DOCS + "select content_hash, count(*) n, min(id) first_id from docs group by 1",
    "term_frequency": "select term, count(*) df from (select unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'))) term from benchmark) group by 1",
    "text_availability": "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)",
    "knn": _KNN + "select query_id, item_id, score, rank from r where rank <= 5",
    "knn_metrics": _KNN + ", n as (select query_id, count(*) n from s where hit group by 1), h as (select query_id, sum(hit::int) h, count(*) r, min(case when hit then rank end) f, sum(case when hit then 1 / log2(rank + 1) else 0 end) dcg from r where rank <= 10 group by 1) select query_id, round(h / n, 6) recall, round(h / r, 6) as precision, round(coalesce(1 / f, 0), 6) rr, round(dcg / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= n), 6) ndcg from h join n using (query_id)",
    "latency_p95": "select operation, n, latency_ms p95 from (select event_type operation, value latency_ms, row_number() over (partition by event_type order by value, event_id) - 1 i, count(*) over (partition by event_type) n from events) where i = floor(0.95 * (n - 1))",
    "feedback_counts": """select ['right','wrong','abstained_wrongly'][k % 7 % 3 + 1] verdict, ['confident','ambiguous','abstained'][k % 3 + 1] match_status, count(*) n from (select cast(replace(replace(props,'{"k": ',''),'}','') as int) k from events) where k % 5 = 0 group by all""",
    "activity": ARCHIVE_SQL + "select corpus_id, event, strftime(date_trunc('day', observed_at), '%Y-%m-%d') as day, count(*) n from v group by all",
}
QUERIES = {name: globals()[name] for name in ORACLES}
