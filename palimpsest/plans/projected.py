"""Registered queries of whole nested answers, closures and orders over graphs, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import closures, projection
from palimpsest.plans.registry import ARCHIVE_SQL, EARLY, EDGES_SQL, NOW
from palimpsest.sources import archive
from palimpsest.sources.archive import table

CUTS = (EARLY, NOW, "2024-01-31 00:00:00")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every signup asks for its user's document, those with an id divisible by 50 for the whole corpus, at one of three times."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    user = F.col("user_id").cast("string")
    path = F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("users/"), (F.col("user_id") % 7).cast("string"), F.lit("/"), user, F.lit(".md")))
    at = F.element_at(F.array(*[F.lit(t).cast("timestamp") for t in CUTS]), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("corpus_id"), at.alias("as_of"), path.alias("path"))


def projected_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers are digested once for each scope, and only the digests go to its requests."""
    v = durable(archive.versions(spark, d))
    c = durable(archive.claims(v))
    e = archive.evidence(c).select("claim_id", F.col("start_offset").cast("int").alias("start_offset"), F.col("end_offset").cast("int").alias("end_offset"))
    asked = _asked(spark, d)
    return projection.to_requests(asked, projection.digests(asked, v, c, e))


def conflict_closures(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a key conflict where their values lie in one span of ten, spans starting at fives, so that conflicts chain;
    every claim of a document with an id divisible by 50 asks."""
    c = archive.claims(archive.versions(spark, d)).withColumn("val", F.col("val").cast("long"))
    spans = F.explode(F.array(*[F.concat_ws("/", F.lit(str(s)), "corpus_id", "key", F.floor((F.col("val") + s) / 10).cast("string")) for s in (0, 5)]))
    members = c.select(spans.alias("conflict_id"), "claim_id")
    return closures.conflict_closure(c.where("doc_id % 50 = 0").select(F.col("claim_id").alias("request_id"), "claim_id"), members)


def ingest_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the order of their supersessions across documents, which run in circles in part; those of even documents
    by odd ones are left out, so that some do not."""
    c = archive.with_topic_edges(archive.claims(archive.versions(spark, d)))
    of = c.select(F.col("claim_id").alias("supersedes_id"), F.col("doc_id").alias("before"))
    edges = c.where("basis = 'topic_key' and not (doc_id % 2 = 1 and val % 2 = 0)").select("supersedes_id", F.col("doc_id").alias("after"), "val").join(of, "supersedes_id").where("before % 2 = 1 or after % 2 = 0")
    return closures.ingest_order(archive.versions(spark, d).select(F.col("doc_id").alias("id")).distinct(), edges)


ORACLES = {
    "conflict_closures": ARCHIVE_SQL.replace("with fx_ev", "with recursive fx_ev", 1)
    + """, m as materialized (select claim_id, s || '/' || corpus_id || '/' || key || '/' || cast(floor((val + s) / 10) as bigint) k from c, (select unnest([0, 5]) s) x),
pr as materialized (select distinct a.claim_id a, b.claim_id b from m a join m b using (k) where a.claim_id <> b.claim_id),
w(request_id, claim_id, n) using key (request_id, claim_id) as (select claim_id, claim_id, 0 from c where doc_id % 50 = 0
 union select w.request_id, b, min(w.n) + 1 from w join pr on a = w.claim_id left join recurring.w o on o.request_id = w.request_id and o.claim_id = b where o.n is null group by w.request_id, b)
select request_id, claim_id, n as round from w""",
    "ingest_order": EDGES_SQL.replace("with fx_ev", "with recursive fx_ev", 1)
    + """, ed as materialized (select distinct b.doc_id before, a.doc_id after from cx a join cx b on b.claim_id = a.supersedes_id where a.basis = 'topic_key' and not (a.doc_id % 2 = 1 and a.val % 2 = 0) and (b.doc_id % 2 = 1 or a.doc_id % 2 = 0) and a.doc_id <> b.doc_id),
nd as materialized (select distinct doc_id id from v),
rc(f, t) as (select before, after from ed union select f, after from rc join ed on before = t),
ra as materialized (select * from rc), cy as materialized (select f id from ra where f = t),
re as materialized (select distinct id from (select id from cy union all select t from ra join cy on f = id) x),
la(id, n) as (select id, 0 from nd where id not in (from re) union select after, n + 1 from la join ed on before = id where after not in (from re)),
lv as materialized (select id, max(n) lvl from la group by 1),
co as materialized (select r.id, least(r.id, coalesce(min(x.t), r.id)) c from re r left join (select a.f, a.t from ra a join ra b on a.f = b.t and a.t = b.f) x on x.f = r.id group by r.id),
ce as materialized (select distinct p.c before, q.c after from ed join co p on p.id = before join co q on q.id = after where p.c <> q.c),
lb(id, n) as (select distinct c, 0 from co union select after, n + 1 from lb join ce on before = id),
lw as materialized (select id, max(n) lvl from lb group by 1)
select id, cast(lvl as int) as level, cast(null as bigint) component from lv union all select co.id, cast(lvl + coalesce((select max(lvl) + 1 from lv), 0) as int), c from co join lw on lw.id = c""",
    "projected_answers": ARCHIVE_SQL
    + f""", cu as (select unnest([timestamp '{CUTS[0]}', timestamp '{CUTS[1]}', timestamp '{CUTS[2]}']) as_of, unnest([0, 1, 2]) i),
rq as (select event_id request_id, 'c' || (user_id % 4) corpus_id, as_of, case when event_id % 50 <> 0 then 'users/' || (user_id % 7) || '/' || user_id || '.md' end path from events join cu on i = event_id % 3 where event_type = 'signup'),
sc as (select distinct corpus_id, as_of, path from rq),
cs as materialized (select c.*, as_of from c join cu on c.observed_at <= as_of),
la as (select doc_id, as_of, max(version_number) n, arg_max(event, version_number) ev from v join cu on observed_at <= as_of group by 1, 2),
gn as (select distinct as_of, supersedes_id claim_id from cs where supersedes_id is not null),
s1 as materialized (select cs.*, la.n is not null and la.ev <> 'DELETED' live, case when gn.claim_id is not null then 'SUPERSEDED' when la.n is null or la.ev = 'DELETED' or not coalesce(valid_from <= cs.as_of, true) or not coalesce(cs.as_of < valid_until, true) then 'UNCERTAIN' else 'CURRENT' end st
  from cs left join gn using (as_of, claim_id) left join la on la.doc_id = cs.doc_id and la.as_of = cs.as_of and la.n = cs.version_number),
sp as (select corpus_id, as_of, key from s1 where st = 'CURRENT' group by all having min(val) <> max(val)),
s2 as materialized (select s1.*, case when st = 'CURRENT' and sp.key is not null then 'CONFLICTING' else st end status from s1 left join sp using (corpus_id, as_of, key)),
i0 as (select sc.corpus_id, sc.as_of, coalesce(sc.path, '') scope, s2.path, key, claim_id, val, version_id, version_number, live, status from sc join s2 on s2.corpus_id = sc.corpus_id and s2.as_of = sc.as_of and (sc.path is null or s2.path = sc.path)),
ns as (select corpus_id, as_of, scope, key, count(*) sides from i0 where status = 'CONFLICTING' group by all),
ch as (select version_id, string_agg(claim, chr(10) order by key, claim) chunk from c group by 1),
ev as (select claim_id, [struct_pack(start_offset := cast(strpos(chunk, claim) - 1 as int), end_offset := cast(strpos(chunk, claim) - 1 + length(claim) as int))] q from c join ch using (version_id)),
i1 as materialized (select i0.* replace (case when status = 'CONFLICTING' and sides < 2 then 'CURRENT' else status end as status), struct_pack(key := key, claim_id := claim_id, val := val, evidence := q) cl from i0 left join ns using (corpus_id, as_of, scope, key) join ev using (claim_id)),
dd as (select corpus_id, as_of, scope, path, coalesce(list(cl order by key, claim_id) filter (where status = 'CURRENT'), []) cur, coalesce(list(cl order by key, claim_id) filter (where status = 'SUPERSEDED' or not live), []) his, coalesce(list(cl order by key, claim_id) filter (where status = 'UNCERTAIN'), []) unc from i1 group by all),
dl as (select corpus_id, as_of, scope, list(struct_pack(path := path, "current" := cur, historical := his, uncertain := unc) order by path) documents, bool_or(len(cur) > 0) any_current from dd group by all),
cf as (select corpus_id, as_of, scope, list(struct_pack(key := key, sides := sides) order by key) conflicts from (select corpus_id, as_of, scope, key, list(claim_id order by claim_id) sides from i1 where status = 'CONFLICTING' group by all) x group by all),
so as (select corpus_id, as_of, scope, list(distinct version_id order by version_id) sources from i1 group by all),
an as (select request_id, struct_pack(state := case when conflicts is not null then 'conflicting' when any_current then 'current' else 'unknown' end, documents := coalesce(documents, []), conflicts := coalesce(conflicts, []), sources := coalesce(sources, [])) answer
  from rq left join dl on dl.corpus_id = rq.corpus_id and dl.as_of = rq.as_of and dl.scope = coalesce(rq.path, '') left join cf on cf.corpus_id = rq.corpus_id and cf.as_of = rq.as_of and cf.scope = coalesce(rq.path, '') left join so on so.corpus_id = rq.corpus_id and so.as_of = rq.as_of and so.scope = coalesce(rq.path, ''))
select request_id, answer.state state, cast(len(answer.documents) as int) n_documents, cast(len(answer.conflicts) as int) n_conflicts, sha256(cast(to_json(answer) as varchar)) digest from an""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
