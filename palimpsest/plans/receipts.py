"""Registered queries of receipts, subjects and hints, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import gates, packs, receipts, relevance, subjects
from palimpsest.plans import gates as gate_plans
from palimpsest.plans.answers import _SCORES, _terms_sql
from palimpsest.plans.registry import EARLY, NOW, _resolved, status_sql
from palimpsest.sources import archive
from palimpsest.sources.archive import table
from palimpsest.streaming import activity, arrivals


def _receipts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, e = _resolved(spark, d), archive.evidence(archive.claims(archive.versions(spark, d)))
    return receipts.answer_receipts(c, e, EARLY, NOW), c, e


def answer_receipts(spark: SparkSession, d: str) -> DataFrame:
    return _receipts(spark, d)[0].select("receipt_id", "corpus_id", "key", "claim_id", "status", "body")


def verified_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of which some were changed afterwards, with and without a new digest."""
    r, c, e = _receipts(spark, d)
    n = F.length("claim") % 5
    body = F.when(n == 0, F.regexp_replace("body", '"status":"[A-Z]+"', '"status":"CURRENT"')).when(n == 1, F.regexp_replace("body", '"start_offset":', '"start_offset":1')).otherwise(F.col("body"))
    given = r.select(body.alias("body"), F.when(n == 1, F.sha2(body, 256)).otherwise(F.col("receipt_id")).alias("receipt_id"))
    return receipts.verify_answers(given, c, e.select("version_id", "chunk"), EARLY)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    weak = F.when(F.col("query_id") % 150 == 0, 0.25).otherwise(1.0)
    return gate_plans._ranked(spark, d, 10).select(F.col("query_id").alias("question_id"), "item_id", (F.col("score") * weak).alias("relevance"), (F.col("item_id") % 10 / 10).alias("overlap"))


def decision_replay(spark: SparkSession, d: str) -> DataFrame:
    """Decisions replayed after the candidates with an id divisible by three are gone; some receipts were damaged."""
    c = _candidates(spark, d)
    given = receipts.decision_receipts(c, 0.3).withColumn("body", F.when(F.col("question_id") % 100 == 50, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return receipts.replay_decisions(given, c.where("item_id % 3 <> 0"), 0.3)


def _subjects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A question's last four words are its subject; those of every fifth name something unheard."""
    b = table(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("question_id"), "text")
    s = b.select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 5 == 0, "zzgrafana quux").when(F.col("item_id") % 5 == 1, "size zzgrafana").otherwise(F.substring_index("text", " ", -4)).alias("subject"))
    return q, s, table(spark, d, "documents").select("doc_id", "text")


def subject_gates(spark: SparkSession, d: str) -> DataFrame:
    q, s, docs = _subjects(spark, d)
    return subjects.subject_gates(s, docs, relevance.overlap_scores(q, docs))


def coverage_order(spark: SparkSession, d: str) -> DataFrame:
    """Sources as keys, scored by the subject and adjusted by the coverage of the question."""
    q, s, docs = _subjects(spark, d)
    keys = table(spark, d, "documents").select("doc_id", F.col("source").alias("key"))
    narrow = relevance.overlap_scores(s.select("question_id", F.col("subject").alias("text")), docs)
    return subjects.coverage_order(narrow, relevance.overlap_scores(q, docs), keys)


def duplicate_hints(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as statements, documents as what is known."""
    q, _, docs = _subjects(spark, d)
    return subjects.duplicate_hints(q.select(F.col("question_id").alias("statement_id"), "text"), docs.select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim")))


def threshold_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents that reach 0.6 of each passage, and how many became candidates."""
    q, _, docs = _subjects(spark, d)
    index = relevance.term_index(docs)
    heads = relevance.threshold_heads(q, index, subjects.HINT)
    met = heads[2].groupBy("question_id").agg(F.count("*").alias("n_candidates"))
    found = relevance.overlap_above(q, index, subjects.HINT, heads).groupBy("question_id").agg(F.count("*").alias("n_found"), F.max("score").alias("best"))
    return q.select("question_id").join(met, "question_id", "left").join(found, "question_id", "left").na.fill(0, ["n_candidates", "n_found"])


def stream_hints(spark: SparkSession, d: str) -> DataFrame:
    """The passages as a stream of statements against a stored index of the documents."""
    _, _, docs = _subjects(spark, d)
    folder = activity.new_folder(spark)
    arrivals.store_index(relevance.term_index(docs), folder)
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/benchmark.parquet").schema).parquet(f"{d}/benchmar[k].parquet")  # a pattern: a table may be one file
    arrivals.hint_stream(stream.select(F.col("item_id").alias("statement_id"), "text"), folder)
    return arrivals.hints_so_far(spark, folder)


def unmatched_parts(spark: SparkSession, d: str) -> DataFrame:
    """The words of a passage by fives as parts of a question."""
    q, _, docs = _subjects(spark, d)
    words = F.split("text", " ", -1)
    fives = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 5).cast("int")), lambda i: F.array_join(F.slice(words, i * 5 + 1, F.lit(5)), " "))
    parts = q.select("question_id", F.posexplode(fives).alias("part", "text"))
    scores = relevance.overlap_above(parts.select(F.concat_ws("/", "question_id", "part").alias("question_id"), "text"), relevance.term_index(docs), 0.65)
    return subjects.unmatched_parts(parts, scores, 0.65)


def contextual_scores(spark: SparkSession, d: str) -> DataFrame:
    q, _, _ = _subjects(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat_ws(" ", F.lit("section data model"), "lang", "source").alias("heading"))
    return gates.shortlist(subjects.contextual_scores(q, docs), "question_id", "doc_id", 5)


BUDGET = 900


def bounded_packs(spark: SparkSession, d: str) -> DataFrame:
    """One answer a corpus, of all its claims."""
    return packs.bounded_pack(packs.units(_resolved(spark, d)), BUDGET)


_FIELDS = {"claim": "claim", "claim_id": "claim_id", "corpus_id": "corpus_id", "end_offset": "end_offset", "inside": "inside", "key": "key", "quote": "claim", "start_offset": "start_offset", "status": "status", "version_id": "version_id"}


def _body(**changed: str) -> str:
    return "to_json({" + ", ".join(f"'{name}': {changed.get(name, value)}" for name, value in _FIELDS.items()) + "})::varchar"


_TRUE = _body()
_GIVEN = f"case length(claim) % 5 when 0 then {_body(status="'CURRENT'")} when 1 then {_body(start_offset="cast('1' || start_offset as int)")} else {_TRUE} end"
_ANSWERS = status_sql(NOW) + f""", ch as (select version_id, string_agg(claim, chr(10) order by key) chunk from c group by 1),
f as (select s.*, valid_from <= timestamp '{EARLY}' and (valid_until is null or timestamp '{EARLY}' < valid_until) inside, strpos(chunk, claim) - 1 start_offset, strpos(chunk, claim) - 1 + length(claim) end_offset, chunk from s join ch using (version_id)),
p as (select * from (select *, row_number() over (partition by corpus_id, key order by inside desc, observed_at desc, claim_id desc) r from f) x where r = 1)
"""
_DECIDE = """, d{i} as (select query_id question_id, item_id, score * case when query_id % 150 = 0 then 0.25 else 1.0 end rel, item_id % 10 / 10 overlap from r where rank <= 10 and {where}), o{i} as (select *, row_number() over (partition by question_id order by rel desc, overlap desc, item_id desc) n from d{i}),
b{i} as (select question_id, max(item_id) filter (where n = 1) item, max(rel) filter (where n = 1) best, coalesce(max(rel) filter (where n = 2), 0) runner from o{i} group by 1),
z{i} as (select question_id, case when best >= 0.3 then item end pick, best < 0.3 or round(least(1, greatest(0, best * 0.7 + (best - runner) * 0.3)), 6) < 0.3 abstained from b{i})"""
_SUBJECT = "case item_id % 5 when 0 then 'zzgrafana quux' when 1 then 'size zzgrafana' else array_to_string(string_split(text, ' ')[-4:], ' ') end"
_NARROW = _SCORES + f""", sq as (select item_id question_id, {_terms_sql(_SUBJECT)} term from benchmark), sw as (select question_id, sq.term, df, ln(((select count(*) from documents) + 1) / (coalesce(df, 0) + 1.0)) + 1 idf from sq left join f on f.term = sq.term),
st as (select question_id, sum(idf) total from sw group by 1), ss as (select sw.question_id, doc_id, round(sum(idf) / any_value(total), 6) score from sw join d on d.term = sw.term join st on st.question_id = sw.question_id group by all)
"""
_KNN = gate_plans._KNN
ORACLES = {
    "answer_receipts": _ANSWERS + f"select sha256({_TRUE}) receipt_id, corpus_id, key, claim_id, status, {_TRUE} body from p",
    "verified_receipts": _ANSWERS + f", g as (select p.*, {_GIVEN} given, length(claim) % 5 n from p) select case when n = 1 then sha256(given) else sha256({_TRUE}) end receipt_id, n <> 0 or status = 'CURRENT' integrity, n <> 1 provenance, true temporal, n <> 0 or status = 'CURRENT' supersession from g",
    "bounded_packs": status_sql(NOW).replace("with fx_ev", "with recursive fx_ev", 1) + f""", x as (select corpus_id, key, claim_id, status, length(to_json({{'claim': claim, 'claim_id': claim_id, 'val': val}})::varchar) size from s),
u as (select corpus_id request_id, case status when 'CURRENT' then 0 when 'SUPERSEDED' then 1 else 3 end field, claim_id unit_id, size from x where status <> 'CONFLICTING'
 union all select corpus_id, 2, key, length('{{"key":"' || key || '","claims":[]}}') + sum(size) + count(*) - 1 from x where status = 'CONFLICTING' group by corpus_id, key),
o as (select *, row_number() over (partition by request_id order by field, unit_id) i from u),
g as (select request_id, 0 i, length('{{"conflicts":[],"current":[],"historical":[],"request":"' || request_id || '","truncated":true,"uncertain":[]}}') used, [-1] seen, false taken from (select distinct request_id from u) y
 union all select g.request_id, o.i, case when fits then cost else used end, case when fits then list_append(seen, field) else seen end, fits from g join lateral (select o.*, g.used + o.size + list_contains(g.seen, o.field)::int cost, g.used + o.size + list_contains(g.seen, o.field)::int <= {BUDGET} fits from o where o.request_id = g.request_id and o.i = g.i + 1) o on true),
e as (select request_id, max(used) used, count(*) - 1 = count(*) filter (where taken) and max(used) + 1 <= {BUDGET} whole from g group by 1)
select g.request_id, ['current', 'historical', 'conflicts', 'uncertain'][field + 1] field, unit_id, size, case when whole then e.used + 1 else e.used end n_chars, not whole truncated from g join o on o.request_id = g.request_id and o.i = g.i join e on e.request_id = g.request_id where taken""",
    "decision_replay": _KNN + _DECIDE.format(i=1, where="true") + _DECIDE.format(i=2, where="item_id % 3 <> 0") + " select z1.question_id, case when z1.question_id % 100 = 50 then 'damaged' when z2.question_id is null then 'gone' when z1.pick is distinct from z2.pick or z1.abstained <> z2.abstained then 'changed' else 'same' end outcome from z1 left join z2 on z2.question_id = z1.question_id",
    "subject_gates": _NARROW + f""", bs as (select question_id, max(score) best from sc group by 1), ab as (select sw.question_id, count(distinct d.doc_id) n, max(sc.score) best from sw join d on d.term = sw.term left join sc on sc.question_id = sw.question_id and sc.doc_id = d.doc_id group by 1),
va as (select distinct sw.term from sw join f on left(f.term, 4) = left(sw.term, 4) where sw.df is null and least(length(f.term), length(sw.term)) >= greatest(4, least(length(f.term), length(sw.term)) - 1) and left(f.term, greatest(4, least(length(f.term), length(sw.term)) - 1)) = left(sw.term, greatest(4, least(length(f.term), length(sw.term)) - 1))),
k as (select question_id, count(df) present, count(*) filter (where df is not null and term not in {tuple(subjects.GENERIC)}) special, bool_or(df is null and term not in (select term from va) and (length(term) <= 3 or length(term) >= 6)) telling from sw group by 1)
select b.item_id question_id, case when coalesce(bs.best, 0) < 0.65 and present = 0 then 'subject_absent' when coalesce(bs.best, 0) < 0.65 and special = 0 and telling then 'distinctive_absent'
 when ab.n / (select count(*) from documents) < 0.01 and ab.best > 0 and ab.best < bs.best * 0.8 then 'subject_not_the_answer' end gate from benchmark b left join k on k.question_id = b.item_id left join bs on bs.question_id = b.item_id left join ab on ab.question_id = b.item_id""",
    "coverage_order": _NARROW + "select ss.question_id, source as key, round(max(ss.score * (1 + coalesce(sc.score, 0))), 6) score from ss left join sc on sc.question_id = ss.question_id and sc.doc_id = ss.doc_id join documents x on x.doc_id = ss.doc_id group by all",
    "duplicate_hints": _SCORES + "select question_id statement_id, doc_id claim_id, score, rank from r where score >= 0.6 and rank <= 3",
    "threshold_join": _SCORES + f""", tt as (select question_id, sum(idf) total from w group by 1), rs as (select w.question_id, w.term, round(sum(w.idf) over (partition by w.question_id order by coalesce(f.df, 0) desc, w.term desc rows unbounded preceding) / total, 9) rest from w left join f on f.term = w.term join tt on tt.question_id = w.question_id),
cn as (select question_id, count(distinct doc_id) n from rs join d on d.term = rs.term where rest >= {subjects.HINT} - 1e-6 group by 1), fo as (select question_id, count(*) n, max(score) best from sc where score >= {subjects.HINT} group by 1)
select b.item_id question_id, coalesce(cn.n, 0) n_candidates, coalesce(fo.n, 0) n_found, best from benchmark b left join cn on cn.question_id = b.item_id left join fo on fo.question_id = b.item_id""",
    "unmatched_parts": f"""with w as (select item_id, string_split(text, ' ') w from benchmark), p as (select item_id, cast(unnest(range(0, (len(w) - 1) // 5 + 1)) as int) part, w from w), x as (select item_id, part, array_to_string(list_slice(w, part * 5 + 1, part * 5 + 5), ' ') text from p),
q as (select item_id, part, {_terms_sql('text')} term from x), d as (select doc_id, {_terms_sql('text')} term from documents), f as (select term, count(*) df from d group by 1),
wt as (select item_id, part, q.term, ln(((select count(*) from documents) + 1) / (coalesce(df, 0) + 1.0)) + 1 idf from q left join f on f.term = q.term), t as (select item_id, part, sum(idf) total from wt group by all),
sc as (select wt.item_id, wt.part, doc_id, round(sum(idf) / any_value(total), 6) score from wt join d on d.term = wt.term join t on t.item_id = wt.item_id and t.part = wt.part group by all)
select item_id question_id, part from x where (item_id, part) not in (select (item_id, part) from sc where score >= 0.65)""",
    "contextual_scores": _SCORES.split("sc as (")[0] + f"hd as (select doc_id, {_terms_sql(chr(39) + 'section data model ' + chr(39) + ' || lang || ' + chr(39) + ' ' + chr(39) + ' || source || ' + chr(39) + ' ' + chr(39) + ' || text')} term from documents), sc as (select w.question_id, doc_id, round(sum(idf) / any_value(total), 6) score from w join hd on hd.term = w.term join t on t.question_id = w.question_id group by all) select * from (select *, row_number() over (partition by question_id order by score desc, doc_id) as rank from sc) where rank <= 5",
}
ORACLES["stream_hints"] = ORACLES["duplicate_hints"]
QUERIES = {name: globals()[name] for name in ORACLES}
