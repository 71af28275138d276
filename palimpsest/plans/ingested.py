"""Registered queries of ingest: files read by their formats into a stored index, statements remembered as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import merges, statements
from palimpsest.plans.matching import pick, pick_sql
from palimpsest.sources import directory
from palimpsest.sources.archive import table
from palimpsest.streaming import activity

EXTENSIONS = ("txt", "md", "py", "json", "MD", "bin", "markdown")
CORPUS = "shelf"


def _files(spark: SparkSession, d: str, later: bool) -> DataFrame:
    """Documents as files of several formats, some of bytes that are no UTF-8: a first state and a later one, with changed,
    new, missing and broken files."""
    x, kind = F.col("doc_id"), pick(EXTENSIONS, F.col("doc_id"))
    docs = table(spark, d, "documents").where("text is not null").where("doc_id % 13 <> 0" if later else "doc_id % 10 <> 0")
    front = F.concat(F.lit("---\ntitle: T "), x, F.lit("\ntags: [a, \"b c\"]\ndocument_type: "), F.when(x % 2 == 0, "paper").otherwise("blog"), F.lit("\nsummary: About "), x, F.lit("\n---\n\n# H\n\n"), "text")
    said = F.when(kind.isin("md", "MD", "markdown"), front).when(kind == "json", F.when(x % 4 == 3, F.concat(F.lit('{"k'), x, F.lit('": 1, "b": [2]}'))).otherwise('{"k')).otherwise(F.col("text"))
    said = F.when(F.lit(later) & (x % 9 == 0), F.concat(said, F.lit("!"))).otherwise(said)
    broken = (x % 17 == 0) | (F.lit(later) & (x % 19 == 0))
    content = F.when(broken, F.concat(F.unhex(F.lit("FF")), F.encode(said, "UTF-8"))).otherwise(F.encode(said, "UTF-8"))
    return docs.select(F.concat("source", F.lit("/"), x, F.lit("."), kind).alias("path"), content.alias("content"))


def _ingested(spark: SparkSession, d: str) -> tuple[str, list[DataFrame]]:
    store = activity.new_folder(spark)
    told = [directory.ingest(store, batch, _files(spark, d, batch > 0), CORPUS) for batch in (0, 1, 1)]  # 1 again, as after a failure
    return store, told[:1] + told[2:]


def ingested_documents(spark: SparkSession, d: str) -> DataFrame:
    store, _ = _ingested(spark, d)
    docs = merges.read(spark, f"{store}/documents", directory.DOCUMENTS)
    return docs.select("path", "title", "document_type", F.array_join("tags", "|").alias("tags"), "summary", F.sha2("body", 256).alias("body"))


def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    _, told = _ingested(spark, d)
    rows = [t.groupBy("outcome", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n")).withColumn("batch", F.lit(b)) for b, t in enumerate(told)]
    return rows[0].unionByName(rows[1])


SCOPES = (None, "a/b", "/bad", "a/../b", "topic")
STATES = (None, "draft", "rejected", "odd")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Turns as statements to remember, with keys, scopes and states of all kinds, some refused."""
    c, t = F.col("conv_id"), F.coalesce("turn", F.lit(0))
    key = F.when(t % 4 == 0, F.concat(F.lit("Conv "), c)).when(t % 4 == 2, F.concat(F.lit(" topic/"), c % 5, F.lit(" "))).when((t % 4 == 3) & (c % 2 == 0), " ")
    return table(spark, d, "conversations").select(
        (c * 1000 + t).alias("request_id"), F.concat(F.lit("c"), c % 3).alias("corpus_id"), F.col("text").alias("statement"), key.alias("key"), pick(SCOPES, c).alias("scope"),
        pick(STATES, c + t).alias("state"), F.lit("2024-01-01").cast("date").alias("day"), t.alias("turn"),
    )


def remembered(spark: SparkSession, d: str) -> DataFrame:
    return statements.remembered(_requests(spark, d)).select("request_id", "reason", "key", "path", F.sha2("raw", 256).alias("document"))


def remembered_store(spark: SparkSession, d: str) -> DataFrame:
    """Statements of the first turns, then of all later ones, the later twice: what is stored at the end."""
    store, asked = activity.new_folder(spark), _requests(spark, d)
    for batch, part in ((0, "turn < 3"), (1, "turn >= 3"), (1, "turn >= 3")):
        statements.remember(store, batch, asked.where(part).drop("turn"))
    return merges.read(spark, store, statements.STORED).select("corpus_id", "path", "key", "state", F.sha2("statement", 256).alias("statement"))


_S = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_SAID = """case when ext in ('md', 'MD', 'markdown') then {text} when ext = 'json' then case when doc_id % 4 = 3 then '{{"k' || doc_id || '": 1, "b": [2]}}' else '{{"k' end || mark else {text} end"""
_FILES = f"""with f as (select doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') as text, {pick_sql(EXTENSIONS, "doc_id")} ext, source || '/' || doc_id || '.' || {pick_sql(EXTENSIONS, "doc_id")} path,
 doc_id % 10 <> 0 in0, doc_id % 13 <> 0 in1, ext <> 'bin' and doc_id % 17 <> 0 ok0, ok0 and doc_id % 19 <> 0 ok1, in0 and ok0 was from documents where text is not null),
o as (select *, case when in1 and ok1 then case when not was then 'added' when doc_id % 9 = 0 then 'changed' else 'unchanged' end when in1 then 'failed' when was then 'deleted' end late, case when ext = 'bin' then 'unsupported' else 'not_utf8' end why from f)
"""
_KEYED = f"""with r as (select conv_id * 1000 + coalesce(turn, 0) request_id, coalesce(turn, 0) turn, 'c' || conv_id % 3 corpus_id, {_S("regexp_replace(regexp_replace(regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g'), '\\s+', ' ', 'g'), '^#+', '')")} said,
 case when coalesce(turn, 0) % 4 = 0 then 'Conv ' || conv_id when coalesce(turn, 0) % 4 = 2 then ' topic/' || conv_id % 5 || ' ' when coalesce(turn, 0) % 4 = 3 and conv_id % 2 = 0 then ' ' end as key, {pick_sql(SCOPES, "conv_id")} scope, coalesce({pick_sql(STATES, "(conv_id + coalesce(turn, 0))")}, 'approved') as state from conversations),
q as (select *, case when state = 'odd' then 'invalid_state' when scope in ('/bad', 'a/../b') then 'invalid_scope' when coalesce(said, '') = '' then 'statement_empty' when length(said) > 4000 then 'statement_too_long' when trim(key) = '' then 'key_blank' end reason,
 coalesce(trim(key), 'text:' || sha256(to_json([said]))) own from r),
k as (select *, case when reason is null then case when scope is null or starts_with(own, scope || '/') then own else scope || '/' || own end end k from q),
g as (select *, regexp_replace(left(regexp_replace(regexp_replace(lower(k), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 48), '^[-.]+|[-.]+$', '', 'g') slug, {_S("string_split(said, '. ')[1]")} f0 from k),
m as (select *, case when k is not null then coalesce(scope || '/', '') || 'memory/' || slug || '-' || left(sha256(k), 12) || '.md' end path, case when length(f0) > 83 then left(f0, 80) || '...' when f0 = '' then 'Memory' else f0 end title,
 replace(replace(said, '\\', '\\\\'), '"', '\\"') esc from g)
"""
ORACLES = {
    "ingested_documents": _FILES
    + f""", x as (select *, case when doc_id % 9 = 0 and late = 'changed' or doc_id % 9 = 0 and late = 'added' then '!' else '' end mark from o where late in ('added', 'changed', 'unchanged') or (late = 'failed' and was)),
y as (select *, {_SAID.format(text="text || mark")} raw, doc_id || '.' || ext as name from x),
z as (select *, coalesce(left({_S("list_filter(string_split(raw, chr(10)), lambda l: " + _S("l") + " <> '')[1]")}, 120), doc_id::varchar) line from y)
select path, case when ext in ('md', 'MD', 'markdown') then 'T ' || doc_id when ext = 'py' then name || ' (python)' when ext = 'json' then doc_id::varchar else line end title,
 case when ext in ('md', 'MD', 'markdown') and doc_id % 2 = 0 then 'paper' else 'note' end document_type, case when ext in ('md', 'MD', 'markdown') then 'a|b c' when ext = 'py' then 'code|python' when ext = 'json' then 'json' else 'text' end tags,
 case when ext in ('md', 'MD', 'markdown') then 'About ' || doc_id when ext = 'py' then 'Source code file ' || name when ext = 'txt' then 'Plain text document: ' || name when doc_id % 4 = 3 and mark = '' then 'JSON document with keys: k' || doc_id || ', b' else 'JSON document (unparseable)' end summary,
 sha256(case when ext in ('md', 'MD', 'markdown') then {_S("'# H' || chr(10) || chr(10) || raw")} when ext = 'txt' then '# ' || line || chr(10) || chr(10) || {_S("raw")}
  else '# ' || case when ext = 'json' then doc_id::varchar else name end || chr(10) || chr(10) || '```' || case when ext = 'json' then 'json' else 'python' end || chr(10) || {_S("raw")} || chr(10) || '```' || chr(10) end) body from z""",
    "ingest_outcomes": _FILES
    + """select cast(0 as int) batch, case when ok0 then 'added' else 'failed' end outcome, case when ok0 then '' else why end reason, count(*) n from o where in0 group by all union all
select 1, late, case when late = 'failed' then why else '' end, count(*) from o where late is not null group by all""",
    "remembered": _KEYED
    + """select request_id, reason, k as key, path, case when k is not null then sha256('---' || chr(10) || 'title: "' || replace(replace(title, '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || 'date: 2024-01-01' || chr(10) || 'document_type: note' || chr(10)
 || case when state <> 'approved' then 'status: ' || state || chr(10) else '' end || 'claims:' || chr(10) || '  - key: "' || k || '"' || chr(10) || '    claim: "' || esc || '"' || chr(10) || '    value: "' || esc || '"' || chr(10) || '    evidence: "' || esc || '"' || chr(10)
 || case when state <> 'approved' then '    info_state: ' || state || chr(10) else '' end || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || said || chr(10)) end document from m""",
    "remembered_store": _KEYED + "select corpus_id, path, arg_max(k, (turn >= 3, request_id)) as key, arg_max(state, (turn >= 3, request_id)) as state, sha256(arg_max(said, (turn >= 3, request_id))) as statement from m where k is not null group by 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLES}
