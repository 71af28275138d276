"""Registered queries of matching, classification and scopes, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import matching, state
from palimpsest.plans.registry import _DOCS, EDGES_SQL
from palimpsest.sources import archive
from palimpsest.sources.archive import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return archive.with_topic_edges(archive.claims(archive.versions(spark, d)))


def pick(names: tuple, at):
    """One of a few names, by the remainder of a number."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (at % len(names) + 1).cast("int"))


def pick_sql(names: tuple, at: str) -> str:
    return "[" + ", ".join("null" if n is None else "'" + n.replace("'", "''") + "'" for n in names) + f"][cast(({at}) % {len(names)} as int) + 1]"


WORDS = ("", " balance", " monthly balance of everything unheard here")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A question for every fifth document: what was its click, with words that no claim holds in some."""
    docs = archive.versions(spark, d).where("doc_id % 5 = 0").select("corpus_id", "doc_id").distinct()
    text = F.concat(F.lit("How did the click of user "), "doc_id", F.lit(" change"), pick(WORDS, F.floor(F.col("doc_id") / 5)), F.lit("?"))
    return docs.select(F.col("doc_id").alias("request_id"), "corpus_id", F.regexp_replace(text, " change", "").alias("text"))


def strict_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.strict_match(_requests(spark, d), _edges(spark, d))


def relaxed_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.relaxed_match(_requests(spark, d), _edges(spark, d))


def lineage_match(spark: SparkSession, d: str) -> DataFrame:
    c = _edges(spark, d)
    return matching.lineage_match(_requests(spark, d), c, state.lineage(c))


QUESTIONS = (
    "What is the view now?", "Which sources disagree?", "What evidence is there?", "What replaced it?", "What held before?", "", "Status on 2024-01-10?",
    "Between 2024-01-01 and 2024-01-05?", "At stage b?", "Anything on 2024-13-45?", "Who is it?", "The older value",
)


def query_intents(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "events").select(F.col("event_id").alias("question_id"), pick(QUESTIONS, F.col("event_id")).alias("text"))
    return matching.intents(q).withColumn("cutoff", F.date_format("cutoff", "yyyy-MM-dd"))


SAYINGS = (" must stay", " was approved", " missed target", " is 5%", " and nothing")
HEADINGS = ("Samples", "Notes", "Draft: prices", "Draftsman tips", "Lessons  learned - 2023", "Archive", "rejected")


def memory_roles(spark: SparkSession, d: str) -> DataFrame:
    c = archive.claims(archive.versions(spark, d))
    claim = F.concat("claim", pick(SAYINGS, F.col("val")))
    return c.select("claim_id", matching.role(claim, pick(HEADINGS, F.col("doc_id"))).alias("role"))


STATUS = ("Approved", " WIP ", "rejected", "archived", "unreviewed", "past campaign", "nonsense", None, "")
TAGS = ("x,y", "draft, x", "a,Obsolete", "")


def _states(spark: SparkSession, d: str) -> DataFrame:
    docs = archive.versions(spark, d).select("doc_id").distinct()
    return matching.document_states(docs.select("doc_id", pick(STATUS, F.col("doc_id")).alias("status"), pick(TAGS, F.floor(F.col("doc_id") / 3)).alias("tags")))


def document_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("doc_id", "state", "warning")


def claim_states(spark: SparkSession, d: str) -> DataFrame:
    c = archive.claims(archive.versions(spark, d))
    path = F.concat(pick(HEADINGS, F.col("val")), F.lit(" > "), pick(HEADINGS, F.floor(F.col("val") / 7)))
    return matching.combined_states(c.select("claim_id", "doc_id", path.alias("heading_path")), _states(spark, d))


def scope_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Users as principals, granted the corpora of their purchases' days; every third request names a corpus."""
    e = table(spark, d, "events")
    grants = e.where("event_type = 'purchase' and user_id % 3 <> 0").select(F.col("user_id").alias("principal"), F.concat(F.lit("c"), F.dayofmonth("ts") % (F.col("user_id") % 3)).alias("corpus_id"))
    asked = e.where("event_type = 'signup'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("principal"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("event_id") % 4)).alias("corpus_id"))
    return matching.resolve_scopes(asked, grants)


def document_references(spark: SparkSession, d: str) -> DataFrame:
    v = archive.versions(spark, d).select("doc_id", "path").distinct()
    ref = F.when(F.col("doc_id") % 4 == 0, F.upper("path")).when(F.col("doc_id") % 4 == 1, F.concat("doc_id", F.lit(".MD"))).when(F.col("doc_id") % 4 == 2, F.concat("doc_id", F.lit("x.md"))).otherwise(F.lit("index.md"))
    twice = v.where("doc_id < 40").select("doc_id", F.concat(F.lit("notes/"), "doc_id", F.lit("/index.md")).alias("path"))
    return matching.document_references(v.select(F.col("doc_id").alias("ref_id"), ref.alias("ref")), v.union(twice))


def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every live document asked for by its path, some by a path that is not there."""
    docs = archive.documents(spark, d)
    asked = docs.select(F.col("id").alias("request_id"), "corpus_id", F.concat("path", F.when(F.col("id") % 9 == 0, "?").otherwise("")).alias("path"))
    hit = asked.join(docs.select("corpus_id", "path", "id"), ["corpus_id", "path"], "left")
    return hit.select("request_id", F.when(F.col("id").isNull(), "document_not_found").otherwise("found").alias("outcome"), "id")


def selected_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, None, None, None, None), (2, "c1", None, None, None), (3, None, "note", "2024-02-01", None), (4, "c2", "note", None, "2024-06-30"), (5, "c3", "paper", "2024-03-01", "2024-03-31")]
    asked = spark.createDataFrame(rows, "request_id long, corpus_id string, document_type string, since string, until string")
    asked = asked.withColumns({"since": F.col("since").cast("date"), "until": F.col("until").cast("date")})
    return matching.any_selectors(asked, archive.documents(spark, d)).groupBy("request_id").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


_STOP = "[" + ", ".join(f"'{w}'" for w in matching.STOPWORDS) + "]"
_FRAME = "[" + ", ".join(f"'{w}'" for w in matching.FRAMING) + "]"
_WORDS = r"list_distinct(regexp_extract_all(lower({x}), '\w+'))"
_CONTENT = f"list_filter({_WORDS}, lambda w: not list_contains({_STOP}, w))"
_NEEDS = "cast(len(list_filter(terms, lambda w: list_contains({hay}, w))) as double) / greatest(len(terms), 1)"
_MATCH = EDGES_SQL + f""", q as (select distinct doc_id request_id, corpus_id, 'How did the click of user ' || doc_id || {pick_sql(WORDS, "doc_id // 5")} || '?' as text from v where doc_id % 5 = 0),
r as (select request_id, corpus_id, {_CONTENT.format(x="text")} as terms from q),
h as (select corpus_id, claim_id, {_WORDS.format(x="key || ' ' || claim || ' ' || val || ' ' || path")} hay, {_CONTENT.format(x="claim")} said from cx),
strict as (select request_id, claim_id from r join h using (corpus_id) where len(list_filter(terms, lambda w: not list_contains(hay, w))) = 0)
"""
_CHAINS = """, recursive_edges as (select claim_id, supersedes_id from cx where supersedes_id is not null and supersedes_id in (select claim_id from cx)),
up as (with recursive walk(claim_id, node) as (select claim_id, claim_id from cx union all select w.claim_id, e.supersedes_id from walk w join recursive_edges e on e.claim_id = w.node)
 select claim_id, node chain_id from walk where node not in (select claim_id from recursive_edges))
"""


def _rank_sql(value: str) -> str:
    return "case " + " ".join(f"when lower(trim({value})) in ({', '.join(repr(x) for x in names)}) then {matching.STATES.index(s)}" for s, names in matching.STATE_VALUES.items()) + " end"


def _heading_sql(part: str) -> str:
    tests = [rf"case when regexp_matches(lower(trim(regexp_replace({part}, '\s+', ' ', 'g'))), '^({'|'.join(w)})($|[ :-])') then {matching.STATES.index(s)} end" for s, w in matching.HEADING_WORDS.items()]
    return "greatest(" + ", ".join(tests) + ")"


def _rules_sql(text: str, rules: dict[str, str], otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{p}') then '{n}'" for n, p in rules.items()) + f" else '{otherwise}' end"


_NAMES = "[" + ", ".join(f"'{s}'" for s in matching.STATES) + "]"
_STATES = EDGES_SQL + f""", ds as (select doc_id, {pick_sql(STATUS, "doc_id")} status, {pick_sql(TAGS, "doc_id // 3")} tags from (select distinct doc_id from v) x),
sr as (select doc_id, status, coalesce(greatest({_rank_sql("status")}, list_max(list_transform(string_split(tags, ','), lambda t: {_rank_sql("t")}))), 0) as rank from ds)
"""
ORACLES = {
    "strict_match": _MATCH + "select * from strict",
    "relaxed_match": _MATCH + f""", scored as (select request_id, claim_id, {_NEEDS.format(hay="said")} score from r join h using (corpus_id) where request_id not in (select request_id from strict)),
best as (select *, max(score) over (partition by request_id) best from scored where score >= 0.3)
select request_id, claim_id, round(score, 6) score from best where best - score <= 0.1""",
    "lineage_match": _MATCH.replace(_CONTENT.format(x="text"), f"list_filter({_CONTENT.format(x='text')}, lambda w: not list_contains({_FRAME}, w))") + _CHAINS + f""", hc as (select h.*, chain_id from h join up using (claim_id)),
ch as (select corpus_id, chain_id, list_distinct(flatten(list(hay))) hay, list_distinct(flatten(list(said))) said from hc group by all),
able as (select request_id, chain_id, max(greatest({_NEEDS.format(hay="hay")}, {_NEEDS.format(hay="said")})) own from r join hc using (corpus_id) group by all),
sc as (select request_id, chain_id, case when len(list_filter(terms, lambda w: not list_contains(hay, w))) = 0 then 2.0 when own >= 0.3 then {_NEEDS.format(hay="said")} else 0 end score from r join ch using (corpus_id) join able using (request_id, chain_id)),
best as (select *, max(score) over (partition by request_id) best from sc where score >= 0.3)
select request_id, chain_id, round(least(score, 1.0), 6) score from best where best - score <= 0.1 and (best < 2 or score = 2)""",
    "query_intents": f"""with q as (select event_id question_id, {pick_sql(QUESTIONS, "event_id")} as text from events),
x as (select *, lower(text) low, regexp_extract_all(lower(text), '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') dates from q),
y as (select *, case when len(dates) = 1 then try_cast(dates[1] as date) end cut from x),
z as (select *, case when trim(text) = '' then 'invalid_query' when len(dates) > 1 then 'several_dates' when len(dates) = 1 and cut is null then 'invalid_date' when len(dates) = 0 and regexp_matches(low, '\\bstage\\s+[a-z0-9]+\\b') then 'stage_without_cutoff' end error from y)
select question_id, case when error is null then case when cut is not null then 'temporal' else {_rules_sql("low", matching.INTENTS, "current")} end end intent, case when error is null then cast(cut as varchar) end cutoff, error from z""",
    "memory_roles": EDGES_SQL + f"""select claim_id, case when regexp_matches(lower({pick_sql(HEADINGS, "doc_id")}), 'example|approved copy|sample') then 'example' else {_rules_sql(f"lower(claim || {pick_sql(SAYINGS, 'val')})", matching.ROLES, "fact")} end as role from c""",
    "document_states": _STATES + f"select doc_id, {_NAMES}[rank + 1] state, case when trim(status) <> '' and {_rank_sql('status')} is null then 'unknown_status:' || lower(trim(status)) end warning from sr",
    "claim_states": _STATES + f""", hr as (select i, coalesce({_heading_sql("h")}, 0) own from (select i, {pick_sql(HEADINGS, "i")} h from range({len(HEADINGS)}) t(i)) x),
dr as materialized (select doc_id, max(rank) as rank from sr group by 1), cc as materialized (select claim_id, doc_id, val % {len(HEADINGS)} a, val // 7 % {len(HEADINGS)} b from c)
select claim_id, {_NAMES}[greatest(x.own, y.own, rank) + 1] state from cc join hr x on x.i = a join hr y on y.i = b join dr using (doc_id)""",
    "scope_resolution": """with g as (select user_id principal, 'c' || (day(ts) % (user_id % 3)) corpus_id from events where event_type = 'purchase' and user_id % 3 <> 0),
o as (select principal, count(distinct corpus_id) n, min(corpus_id) sole from g group by 1),
a as (select event_id request_id, user_id principal, case when event_id % 3 = 0 then 'c' || (event_id % 4) end corpus_id from events where event_type = 'signup'),
j as (select a.*, n, sole, exists (select 1 from g where g.principal = a.principal and g.corpus_id = a.corpus_id) granted from a left join o using (principal)),
k as (select *, case when corpus_id is not null then case when granted then 'named' else 'forbidden' end when n = 1 then 'sole' when n > 1 then 'ambiguous' else 'none' end outcome from j)
select request_id, outcome, case outcome when 'named' then corpus_id when 'sole' then sole end corpus_id from k""",
    "document_references": EDGES_SQL + """, p as (select distinct doc_id, path from v), a as (select doc_id, path from p union all select doc_id, 'notes/' || doc_id || '/index.md' from p where doc_id < 40),
r as (select doc_id ref_id, lower(case doc_id % 4 when 0 then upper(path) when 1 then doc_id || '.MD' when 2 then doc_id || 'x.md' else 'index.md' end) ref from p),
j as (select ref_id, count(a.doc_id) n, min(a.doc_id) one, min(case when lower(a.path) = ref then a.doc_id end) exact from r left join a on lower(a.path) = ref or ends_with(lower(a.path), '/' || ref) group by 1),
k as (select *, case when exact is not null then 'exact' when n = 1 then 'suffix' when n > 1 then 'ambiguous' else 'missing' end outcome from j)
select ref_id, outcome, case outcome when 'exact' then exact when 'suffix' then one end doc_id from k""",
    "path_lookup": _DOCS + "select id request_id, case when id % 9 = 0 then 'document_not_found' else 'found' end outcome, case when id % 9 <> 0 then id end id from docs",
    "selected_documents": _DOCS + """, r(request_id, c, t, a, b) as (values (1, null, null, null, null), (2, 'c1', null, null, null), (3, null, 'note', date '2024-02-01', null), (4, 'c2', 'note', null, date '2024-06-30'), (5, 'c3', 'paper', date '2024-03-01', date '2024-03-31'))
select cast(request_id as bigint) request_id, count(*) n, max(id) last_id from r join docs on (c is null or c = corpus_id) and (t is null or t = document_type) and (a is null or date >= a) and (b is null or date <= b) group by 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
