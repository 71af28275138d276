"""Registered queries of responses held against the archive, chunk baselines and the claim in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import relevance, responses, state
from palimpsest.plans.registry import EARLY, NOW, status_sql
from palimpsest.sources import archive
from palimpsest.sources.archive import table

BUDGET, ENVELOPE = 130, 2000


def response_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Answers of every key, cut at 120 characters of claims and then damaged by their values: claims dropped, renamed or promoted,
    evidence that is not exact, and wrong words on being cut."""
    v = archive.versions(spark, d)
    r = state.resolve(v, archive.claims(v), NOW)
    c = r.where("status in ('CURRENT', 'CONFLICTING')").withColumn("request_id", F.concat_ws("/", "corpus_id", "key"))
    kept = relevance.prefix_budget(c, "request_id", [F.col("status"), F.desc("val"), F.col("claim_id")], F.length("claim"), 120).where("val % 37 <> 0")
    returned = kept.select("request_id", F.when(F.col("val") % 41 == 0, F.concat("claim_id", F.lit("x"))).otherwise(F.col("claim_id")).alias("claim_id"), F.when(F.col("val") % 50 == 0, "CURRENT").otherwise(F.col("status")).alias("status"))
    n = c.groupBy("request_id").agg(F.count("*").alias("n")).join(kept.groupBy("request_id").agg(F.count("*").alias("m"), F.sum(F.length("claim")).alias("size")), "request_id", "left")
    told = n.select("request_id", (F.coalesce("size", F.lit(0)) + 20).alias("characters"), F.lit(BUDGET).alias("budget"), ((F.coalesce("m", F.lit(0)) < F.col("n")) != (F.col("n") % 3 == 0)).alias("truncated"))
    return responses.invariants(told, returned, c.select("request_id", "claim_id"), r, r.select("claim_id", (F.col("val") % 53 != 0).alias("exact")))


def chunk_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark passage as a question; its candidates are the lines of documents by remainder, the longest first."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.when(F.col("item_id") % 10 == 0, F.repeat("text", F.lit(30))).otherwise(F.col("text")).alias("question"))
    lines = archive.line_chunks(archive.documents(spark, d)).withColumn("_r", F.col("doc_id") % 40)
    candidates = asked.select("request_id", (F.col("request_id") % 40).alias("_r")).join(lines, "_r").select("request_id", (F.col("doc_id") * 100_000 + F.col("order_index")).alias("id"), F.length("text").alias("score"), F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    return responses.chunk_envelopes(asked, candidates, ENVELOPE)[1]


def in_force_tiers(spark: SparkSession, d: str) -> DataFrame:
    v = archive.versions(spark, d)
    return responses.in_force_tiers(state.resolve(v, archive.claims(v), NOW), EARLY, EARLY)


_E = f"timestamp '{EARLY}'"
ORACLES = {
    "response_invariants": status_sql(NOW)
    + f""", shown as (select *, corpus_id || '/' || key request_id, sum(length(claim)) over (partition by corpus_id, key order by status, val desc, claim_id rows unbounded preceding) used from s where status in ('CURRENT', 'CONFLICTING')),
k as (select * from shown where used <= 120 and val % 37 <> 0), ret as (select request_id, case when val % 41 = 0 then claim_id || 'x' else claim_id end claim_id, case when val % 50 = 0 then 'CURRENT' else status end told from k),
n as (select request_id, count(*) n from shown group by 1), m as (select request_id, count(*) m, sum(length(claim)) size from k group by 1),
r as (select request_id, coalesce(size, 0) + 20 characters, (coalesce(m, 0) < n) <> (n % 3 = 0) truncated from n left join m using (request_id)),
j as (select ret.*, s.corpus_id, s.key, s.status, s.val from ret left join s using (claim_id)),
b as (select request_id, bool_and(coalesce(val % 53 <> 0, false)) provenance, bool_and(not (told = 'CURRENT' and status is distinct from 'CURRENT')) current_authority_preserved, bool_and(status is not null) temporal_scope_preserved, bool_and(told is not distinct from status) status_preserved,
 bool_and(status is distinct from 'CONFLICTING' or (select count(*) from j o where o.request_id = j.request_id and o.corpus_id = j.corpus_id and o.key = j.key and o.status = 'CONFLICTING') = (select count(*) from s where s.corpus_id = j.corpus_id and s.key = j.key and s.status = 'CONFLICTING')) conflict_closed from j group by 1),
x as (select request_id, bool_or(ret.claim_id is null or shown.claim_id is null) dropped from ret full join shown using (request_id, claim_id) group by 1)
select request_id, coalesce(provenance, true) provenance, characters <= {BUDGET} within_budget, coalesce(conflict_closed, true) conflict_closed, coalesce(current_authority_preserved, true) current_authority_preserved,
 truncated = (dropped or characters + truncated::int > {BUDGET}) truncated_correct, coalesce(temporal_scope_preserved, true) temporal_scope_preserved, coalesce(status_preserved, true) status_preserved from r left join b using (request_id) join x using (request_id)""",
    "chunk_baseline": f"""with a as (select item_id request_id, case when item_id % 10 = 0 then repeat(text, 30) else text end question from benchmark), l0 as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) i from documents),
l as (select request_id, 'd/' || doc_id path, line, doc_id * 100000 + i id, length(to_json({{'path': 'd/' || doc_id, 'text': line}})) + 1 size from l0 join a on request_id % 40 = doc_id % 40 where trim(line, ' ') <> ''),
b as (select request_id, length(to_json(question)) + length('{{"chunks":[],"query":,"truncated":true}}') base from a),
g as (select request_id, count(*) n, list(size order by length(line) desc, id) sizes from l group by 1),
p as (select request_id, base, coalesce(n, 0) n, list_reduce(list_prepend(cast(base - 1 as bigint), coalesce(sizes, [])), lambda z, y: case when z % 4294967296 + y <= {ENVELOPE} then z + y + 4294967296 else z end) z from b left join g using (request_id)),
q as (select request_id, base, n, case when base <= {ENVELOPE} then z // 4294967296 else 0 end m, case when z // 4294967296 = 0 then base else z % 4294967296 end used from p)
select request_id, m n_chunks, case when base <= {ENVELOPE} then used + (m = n and used + 1 <= {ENVELOPE})::int end characters, case when base <= {ENVELOPE} then not (m = n and used + 1 <= {ENVELOPE}) end truncated, case when base > {ENVELOPE} then 'envelope_exceeds_budget' end error from q""",
    "in_force_tiers": status_sql(NOW)
    + f""", t as (select *, case when coalesce(valid_from <= {_E}, true) and coalesce({_E} < valid_until, true) then 1 when observed_at <= {_E} then 2 else 3 end tier from s)
select corpus_id, key, claim_id, cast(tier as int) tier from (select *, row_number() over (partition by corpus_id, key order by tier, case when tier <> 2 then (status <> 'CURRENT')::int else 0 end, case when tier = 2 then -epoch_us(observed_at) else epoch_us(observed_at) end, claim_id) r from t) x where r = 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
