"""Registered queries of gates, targets of supersession, decisions and comparisons, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import gates, matching, retrieve, state
from palimpsest.plans.maintenance import ORACLES as MAINTENANCE, active_claims
from palimpsest.plans.matching import ORACLES as MATCHING, _requests, pick, pick_sql
from palimpsest.plans.registry import _DOCS, _KNN, _labelled, _resolved, _vectors, ARCHIVE_SQL, NOW, status_sql
from palimpsest.sources import archive
from palimpsest.sources.archive import table

OPERATIONS = ("current", "as-of", "history", "changes", "evidence", "snapshot", "replay", "pack", "query", "erase", None)
STATES = (None, None, "draft", "current", None)
FIELDS = {"path": 3, "path_prefix": 4, "as_of": 2, "valid_at": 5, "snapshot_id": 7, "claim_id": 6}


def request_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a request; its selectors come from its number."""
    n = F.floor(F.col("event_id") / 11)
    set_ = {c: F.when(n % m == 0, F.lit("x")).alias(c) for c, m in FIELDS.items()}
    set_["path_prefix"] = F.when(n % 4 == 0, F.when(n % 8 == 0, " ").otherwise("x")).alias("path_prefix")
    states = pick(STATES, n)
    e = table(spark, d, "events").select(F.col("event_id").alias("request_id"), pick(OPERATIONS, F.col("event_id")).alias("operation"), *set_.values(), F.when(states.isNotNull(), F.array(states)).alias("include_states"), F.when(n % 9 == 0, "why").otherwise("").alias("query"))
    return gates.validate_requests(e).select("request_id", "reason")


PREFIXES = ((1, ("users/1",)), (2, ("users/1", "users/2/")), (3, ("users/0", "users/3", "users/5", "users/6")))


def scoped_conflicts(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(i, p) for i, ps in PREFIXES for p in ps], "request_id long, prefix string")
    asked = F.broadcast(asked.withColumn("prefix", F.regexp_replace("prefix", "/+$", "")))
    inside = (F.col("path") == F.col("prefix")) | F.col("path").startswith(F.concat("prefix", F.lit("/")))
    return gates.scope_conflicts(asked, _resolved(spark, d).where("status = 'CONFLICTING'"), inside)


INFO = ("draft", "rejected", "superseded", "approved", None, "approved", "approved")


def withheld_claims(spark: SparkSession, d: str) -> DataFrame:
    c = _resolved(spark, d).where("status in ('CURRENT', 'CONFLICTING')").withColumn("info_state", pick(INFO, F.col("val")))
    return gates.withhold(c, ("draft",)).select("claim_id", "status", "outcome")


def decodable_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every vector, damaged by its number: cut short, a null, a NaN or an infinite component, or missing."""
    v = F.col("embedding")
    broken = lambda x: F.concat(F.slice(v, 1, 63), F.array(F.lit(x).cast("float")))
    n = F.col("vec_id") % 11
    damaged = F.when(n == 1, F.slice(v, 1, 63)).when(n == 2, broken(None)).when(n == 3, broken(float("nan"))).when(n == 4, broken(float("-inf"))).when(n == 5, F.lit(None)).otherwise(v)
    return table(spark, d, "embeddings").withColumn("v", damaged).select("vec_id", gates.decodable("v", 64).alias("decodable"))


def stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Cached vectors whose stored hash is not that of the current text, with the new hash."""
    docs = archive.documents(spark, d)
    cached = docs.select("id", F.sha2(F.concat("text", F.when(F.col("id") % 7 == 0, "!").otherwise("")), 256).alias("stored"))
    return docs.join(cached, "id").where("stored <> content_hash").select("id", "stored", "content_hash")


def version_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = archive.documents(spark, d).select("corpus_id", F.col("id").alias("doc_id"), "document_type", F.col("path").alias("live_path"))
    return archive.versions(spark, d).join(docs, ["corpus_id", "doc_id"]).select("version_id", "doc_id", "document_type", "live_path")


_SAID = "case cast(floor(doc_id / 16) as int) % 3 when 0 then concat(kind, ': ', val) when 1 then concat(kind, ' of a certain user is ', val) else concat('all users hold the same ', val) end"


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The latest claims of each document, as replacing those of the document four before it."""
    v = archive.versions(spark, d)
    live = state.latest_versions(v).where("event <> 'DELETED'").select("version_id")
    c = archive.claims(v).join(live, "version_id", "left_semi").withColumn("kind", F.substring_index("key", ".", 1)).withColumn("claim", F.expr(_SAID))
    return c.select(F.col("doc_id").alias("group_id"), "key", "claim"), c.select((F.col("doc_id") + 4).alias("group_id"), F.col("claim_id").alias("target_id"), "key", "claim")


def paired_targets(spark: SparkSession, d: str) -> DataFrame:
    authored, targets = _groups(spark, d)
    return gates.pair_targets(authored, targets)


def explicit_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each document asks to retire, by turns: a topic, a live claim of the document four before, one that is not there, nothing."""
    active = active_claims(spark, d)
    active = active.join(archive.claims(archive.versions(spark, d)).select("claim_id", "doc_id"), "claim_id")
    own = active.groupBy("corpus_id", "doc_id").agg(F.min("key").alias("least"), F.max("claim_id").alias("most"))
    before = own.select((F.col("doc_id") + 4).alias("doc_id"), F.col("most").alias("before"))
    n = F.col("doc_id") % 5
    topic = F.when(n == 0, F.col("least")).when(n == 1, F.concat(F.lit("view."), F.floor((F.col("doc_id") + 4) / 8)))
    asked = own.join(before, "doc_id", "left").select(F.col("doc_id").alias("request_id"), "corpus_id", "doc_id", F.when(n == 2, F.col("before")).when(n == 3, F.col("most")).alias("supersedes"), topic.alias("topic_key"))
    return gates.explicit_targets(asked, active.select(F.col("doc_id").alias("request_id"), "key"), active)


def _ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieve.top_k(*_vectors(spark, d), k)


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of each query as candidates, a third of the queries with weak scores."""
    weak = F.when(F.col("query_id") % 150 == 0, 0.25).otherwise(1.0)
    c = _ranked(spark, d, 10).select(F.col("query_id").alias("question_id"), "item_id", (F.col("score") * weak).alias("relevance"), (F.col("item_id") % 10 / 10).alias("overlap"))
    return gates.decide(c)


def nearest_active(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest active items; items are taken out before the search, not after it."""
    q, items = _vectors(spark, d)
    return retrieve.top_k(q, items.where("item_id % 3 <> 0"), 5)


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen fetched, five kept by a second score."""
    fetched = _ranked(spark, d, 15)
    return gates.rerank(fetched, fetched.select("query_id", "item_id", (F.col("item_id") * 37 % 101).alias("score")), 5)


def shortlisted_keys(spark: SparkSession, d: str) -> DataFrame:
    """Three documents of each subject with the longest texts."""
    docs = table(spark, d, "documents").where("text is not null").select("source", "doc_id", F.length("text").alias("score"))
    return gates.shortlist(docs, "source", "doc_id", 3)


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """Nearest by vector against the same ones in reverse; every third query is negative."""
    near = durable(_ranked(spark, d, 10).select("query_id", "item_id", "rank"))
    relevant, total = _labelled(spark, d, near)
    both = near.select(F.lit("vector").alias("strategy"), "*").union(near.select(F.lit("reverse"), "query_id", "item_id", 11 - F.col("rank")))
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 150 == 0).alias("negative"))
    return gates.compare_strategies(both, relevant, queries, 5, total)


def heldout(spark: SparkSession, d: str) -> DataFrame:
    """Labels as keys: a query's gold is its own, ranked by the best of its forty nearest items."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    best = _ranked(spark, d, 40).join(e, "item_id").groupBy(F.col("query_id").alias("question_id"), F.col("label").alias("key")).agg(F.max("score").alias("score"))
    ranked = gates.shortlist(best, "question_id", "key", 40)
    return gates.heldout_metrics(ranked, e.where("item_id % 50 = 0").select(F.col("item_id").alias("question_id"), F.col("label").alias("key")))


def pack_equality(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a pack, run again three days later; some runs differ in a body, an order or an item."""
    e = table(spark, d, "events").select(F.col("user_id").alias("pack_id"), F.col("event_id").alias("item_id"), "event_type", "ts")
    left = e.select("pack_id", "item_id", F.col("event_type").alias("body"), F.col("ts").alias("at"))
    n = F.col("pack_id") % 10
    at = F.when(n == 1, F.timestamp_seconds(2_000_000_000 - F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).otherwise(F.col("ts").cast("timestamp") + F.expr("interval 3 days"))
    right = e.where("pack_id % 10 <> 2 or item_id % 2 = 0").select("pack_id", "item_id", F.when(n == 3, F.concat("event_type", F.lit("?"))).otherwise(F.col("event_type")).alias("body"), at.alias("at"))
    return gates.equal_packs(left, right)


def context_strategies(spark: SparkSession, d: str) -> DataFrame:
    r = _requests(spark, d)
    asked = r.withColumn("corpus_id", F.when(F.col("request_id") % 3 == 0, "c9").otherwise(F.col("corpus_id")))
    v = archive.versions(spark, d)
    return gates.context_strategy(asked, v, matching.strict_match(r, archive.with_topic_edges(archive.claims(v))))


def claim_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """The place of each line under its heading; every third line counts as one."""
    k = archive.line_chunks(archive.documents(spark, d)).select("doc_id", F.floor(F.col("order_index") / 3).alias("heading"), "order_index")
    return gates.ordinals(k, ("doc_id", "heading"), "order_index")


def _set(c: str, m: int) -> str:
    return f"case when n % {m} = 0 then {'case when n % 8 = 0 then chr(32) else chr(120) end' if c == 'path_prefix' else 'chr(120)'} end {c}"


def _sql_list(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


_UNSUPPORTED = " or ".join(f"({c} is not null and operation not in ({_sql_list(o for o, allowed in gates.ALLOWED.items() if c in allowed)}))" for c in gates.SELECTORS)
_MISSING = " or ".join(f"(operation = '{o}' and {c} is null)" for o, c in gates.REQUIRED.items())
_LIVE = "live as (select version_id from (select *, row_number() over (partition by doc_id order by version_number desc) r from v) x where r = 1 and event <> 'DELETED')"
_SUBJECT = "nullif(lower(case when claim like '%:%' then trim(split_part(claim, ':', 1)) else array_to_string(list_slice(regexp_split_to_array(trim(claim), '\\s+'), 1, 5), ' ') end), '')"
_ACTIVE = MAINTENANCE["active_claims"].rsplit("select claim_id, corpus_id, key, val from cx", 1)
ORACLES = {
    "request_reasons": f"""with e as (select event_id request_id, {pick_sql(OPERATIONS, 'event_id')} operation, event_id // 11 n from events),
r as (select request_id, operation, {', '.join(_set(c, m) for c, m in FIELDS.items())}, {pick_sql(STATES, 'n')} include_states, case when n % 9 = 0 then 'why' else '' end query from e)
select request_id, case when operation is null or operation not in ({_sql_list(gates.ALLOWED)}) then 'invalid_operation' when {_MISSING} then 'selector_required' when {_UNSUPPORTED} then 'selector_not_supported'
 when include_states not in ({_sql_list(gates.WITHHELD)}) then 'invalid_state' when path is not null and path_prefix is not null then 'path_conflict' when trim(path_prefix) = '' then 'empty_path_prefix'
 when snapshot_id is not null and (as_of is not null or valid_at is not null) then 'snapshot_fixes_cutoffs' when operation = 'snapshot' and query <> '' then 'snapshot_takes_no_query' end reason from r""",
    "scoped_conflicts": status_sql(NOW) + f", p(request_id, prefix) as (values {', '.join(f'''({i}, '{x.rstrip('/')}')''' for i, xs in PREFIXES for x in xs)}), i as (select distinct cast(request_id as bigint) request_id, corpus_id, key, claim_id from s join p on path = prefix or starts_with(path, prefix || '/') where status = 'CONFLICTING') select request_id, claim_id, case when count(*) over (partition by request_id, corpus_id, key) >= 2 then 'kept' else 'promoted' end outcome from i",
    "withheld_claims": status_sql(NOW) + f", w as (select *, coalesce({pick_sql(INFO, 'val')} in ('rejected', 'superseded'), false) hidden from s where status in ('CURRENT', 'CONFLICTING')) select claim_id, status, case when hidden then 'withheld' when status = 'CONFLICTING' and count(*) filter (where not hidden and status = 'CONFLICTING') over (partition by corpus_id, key) = 1 then 'promoted' else 'kept' end outcome from w",
    "decodable_vectors": "select vec_id, vec_id % 11 not between 1 and 5 decodable from embeddings",
    "stale_vectors": "select doc_id id, sha256(text || '!') stored, sha256(text) content_hash from documents where doc_id % 7 = 0 and text is not null",
    "version_documents": ARCHIVE_SQL + ", " + _DOCS.removeprefix("with ") + "select version_id, doc_id, document_type, docs.path live_path from v join docs on docs.id = v.doc_id and docs.corpus_id = v.corpus_id",
    "paired_targets": ARCHIVE_SQL + f""", {_LIVE}, said as (select claim_id, doc_id, key, {_SAID} claim from (select *, split_part(key, '.', 1) kind from c) x where version_id in (select version_id from live)),
t as (select doc_id + 4 group_id, claim_id target_id, key, {_SUBJECT} subject, row_number() over (partition by doc_id, key order by claim_id) nth from said),
a as (select doc_id group_id, key, {_SUBJECT} subject from said),
k as (select t.group_id, target_id, t.key from t join a on a.group_id = t.group_id and a.key = t.key where nth = 1),
ra as (select * from a where (group_id, key) not in (select (group_id, key) from k)), rt as (select * from t where (group_id, target_id) not in (select (group_id, target_id) from k)),
m as (select f.group_id, f.target_id, o.key from (select group_id, subject, min(target_id) target_id from rt group by 1, 2) f join (select group_id, subject, min(key) key from ra group by 1, 2 having count(*) = 1) o on o.group_id = f.group_id and o.subject = f.subject),
p as (select *, 'key' how from k union all select *, 'subject' from m),
z as (select g.group_id, coalesce((select count(*) from a where a.group_id = g.group_id), 0) > coalesce((select count(*) from p where p.group_id = g.group_id), 0) and g.n > coalesce((select count(*) from p where p.group_id = g.group_id), 0) refused from (select group_id, count(*) n from t group by 1) g)
select t.group_id, t.target_id, case when not refused then p.key end as key, case when refused then 'refused' else coalesce(how, 'unpaired') end outcome from t join z on z.group_id = t.group_id left join p on p.group_id = t.group_id and p.target_id = t.target_id""",
    "explicit_targets": _ACTIVE[0].rstrip() + f""", act as (select claim_id, corpus_id, doc_id, key from cx {_ACTIVE[1]}),
own as (select corpus_id, doc_id, min(key) least, max(claim_id) most, count(distinct key) n_keys from act group by all),
q as (select o.*, case doc_id % 5 when 2 then (select b.most from own b where b.doc_id = o.doc_id - 4) when 3 then o.most end supersedes, case doc_id % 5 when 0 then o.least when 1 then 'view.' || cast((doc_id + 4) // 8 as varchar) end topic from own o),
y as (select q.*, n.key named, n.claim_id is not null and n.doc_id <> q.doc_id found, exists (select 1 from act a where a.doc_id = q.doc_id and a.key = n.key) same, exists (select 1 from act a where a.doc_id = q.doc_id and a.key = topic) written,
 (select count(*) from act a where a.corpus_id = q.corpus_id and a.key = topic and a.doc_id <> q.doc_id) others, (select min(claim_id) from act a where a.corpus_id = q.corpus_id and a.key = topic and a.doc_id <> q.doc_id) sole from q left join act n on n.claim_id = supersedes and n.corpus_id = q.corpus_id),
o as (select *, case when topic is not null and not written then 'topic_key_not_authored' when supersedes is not null and not found then 'target_not_active' when supersedes is not null and (same or n_keys = 1) then 'explicit_claim_id' when supersedes is not null then 'ambiguous_authored'
 when topic is not null and others = 0 then 'no_target' when topic is not null and others > 1 then 'topic_ambiguous' when topic is not null then 'topic_key' else 'none' end outcome from y)
select doc_id request_id, outcome, case outcome when 'explicit_claim_id' then supersedes when 'topic_key' then sole end target_id, case outcome when 'explicit_claim_id' then case when same then named else least end when 'topic_key' then topic end as key from o""",
    "decisions": _KNN + ", d as (select query_id question_id, item_id, score * case when query_id % 150 = 0 then 0.25 else 1.0 end rel, item_id % 10 / 10 overlap from r where rank <= 10), o as (select *, row_number() over (partition by question_id order by rel desc, overlap desc, item_id desc) n from d), b as (select question_id, max(item_id) filter (where n = 1) item, max(rel) filter (where n = 1) best, coalesce(max(rel) filter (where n = 2), 0) runner from o group by 1) select question_id, case when best >= 0.3 then item end selected_id, round(least(1, greatest(0, best * 0.7 + (best - runner) * 0.3)), 6) confidence, best < 0.3 or round(least(1, greatest(0, best * 0.7 + (best - runner) * 0.3)), 6) < 0.3 abstained from b",
    "nearest_active": _KNN.split("r as (")[0] + "r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s where item_id % 3 <> 0) select query_id, item_id, score, rank from r where rank <= 5",
    "reranked": _KNN + ", f as (select query_id, item_id, item_id * 37 % 101 score from r where rank <= 15) select * from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from f) x where rank <= 5",
    "shortlisted_keys": "select source, doc_id, score, rank from (select source, doc_id, length(text) score, row_number() over (partition by source order by length(text) desc, doc_id) as rank from documents where text is not null) where rank <= 3",
    "strategies": _KNN + """, b as (select 'vector' strategy, query_id, rank, hit from r where rank <= 10 union all select 'reverse', query_id, 11 - rank, hit from r where rank <= 10),
p as (select strategy, query_id, query_id % 150 = 0 negative, sum(case when hit and query_id % 150 <> 0 then 1 else 0 end) h, count(*) n, min(case when hit then rank end) f, (select count(*) from s where s.query_id = b.query_id and s.hit) total from b where rank <= 5 group by all)
select strategy, round(sum(case when not negative then h / greatest(total, 1) end) / (select count(*) from embeddings where vec_id % 50 = 0 and vec_id % 150 <> 0), 6) recall, round(sum(case when not negative then coalesce(1 / f, 0) end) / (select count(*) from embeddings where vec_id % 50 = 0 and vec_id % 150 <> 0), 6) mrr, round(sum(h / n) / (select count(*) from embeddings where vec_id % 50 = 0), 6) as precision from p group by 1""",
    "heldout": _KNN + """, k as (select query_id, label, max(score) score from r join embeddings e on e.vec_id = item_id where rank <= 40 group by all), o as (select query_id, label, row_number() over (partition by query_id order by score desc, label) as rank from k),
g as (select vec_id, rank from embeddings e left join o on o.query_id = vec_id and o.label = e.label where vec_id % 50 = 0)
select count(*) n_questions, round(avg(coalesce(rank <= 1, false)::int), 6) r1, round(avg(coalesce(rank <= 5, false)::int), 6) r5, round(avg(coalesce(rank <= 10, false)::int), 6) r10, round(avg(coalesce(1 / rank, 0)), 6) mrr,
 round(avg(case when rank <= 5 then 1 / log2(rank + 1) else 0 end) / (1 + 1 / log2(3) + 1 / log2(4) + 1 / log2(5) + 1 / log2(6)), 6) ndcg5, round(avg((rank is not null)::int), 6) ceiling from g""",
    "pack_equality": "with t as (select user_id pack_id, count(*) n, count(distinct ts) times, count(*) filter (where event_id % 2 = 1) odd from events group by 1) select pack_id, case pack_id % 10 when 1 then times = 1 when 2 then odd = 0 when 3 then false else true end equal from t",
    "context_strategies": MATCHING["strict_match"].rsplit("select * from strict", 1)[0] + "select request_id, case when request_id % 3 = 0 then 'retrieval_only' when request_id in (select request_id from strict) then 'authoritative' else 'authoritative_no_retrieval' end strategy from q",
    "claim_ordinals": _DOCS + "select doc_id, order_index, row_number() over (partition by doc_id, order_index // 3 order by order_index) - 1 ordinal from chunks",
}
QUERIES = {name: globals()[name] for name in ORACLES}
