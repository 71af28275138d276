"""Registered queries of relevance, Markdown, graph walks, proofs, evaluation and streams, with DuckDB SQL where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import blocks, evaluate, graph, markdown, relevance, retrieve, state
from palimpsest.plans.registry import _DOCS, ARCHIVE_SQL, EARLY, EDGES_SQL, NOW, status_sql
from palimpsest.sources import archive
from palimpsest.sources.archive import table
from palimpsest.streaming import activity, lifecycle


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return relevance.overlap_scores(_questions(spark, d), table(spark, d, "documents").select("doc_id", "text"))


def relevance_top(spark: SparkSession, d: str) -> DataFrame:
    return relevance.best(_scores(spark, d), "question_id", "doc_id", 3)


def adjudication(spark: SparkSession, d: str) -> DataFrame:
    return relevance.adjudicate(_questions(spark, d), _scores(spark, d), 0.65, 0.05)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    first = F.get(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), F.lit(0))
    titles = table(spark, d, "documents").select("doc_id", F.coalesce(F.substring(F.trim(first), 1, 120), F.lit("")).alias("text"))  # the title of a plain text
    return titles.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), titles.withColumnRenamed("doc_id", "item_id")


def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The ten titles nearest to each title whose id is divisible by 50, of all others that share a trigram with it."""
    return blocks.nearest(*map(relevance.gram_sets, _titles(spark, d)), 10, blocks.common_share, positive=True)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole lists by vector and by title, fused: every row with a vector and a text whose id is divisible by 50, against all others."""
    (q, i), (tq, ti) = _vectors(spark, d), _titles(spark, d)
    both = i.select("item_id").intersect(ti.select("item_id"))
    asked = both.select(F.col("item_id").alias("query_id"))
    feature = retrieve.whole("vector").alias("feature")
    vector = q.join(asked, "query_id", "left_semi").select("query_id", feature), i.join(both, "item_id", "left_semi").select("item_id", feature)
    keyword = relevance.gram_sets(tq.join(asked, "query_id", "left_semi")), relevance.gram_sets(ti.join(both, "item_id", "left_semi"))
    return relevance.fuse_blocks(vector, keyword, both, 5)


def recency_search(spark: SparkSession, d: str) -> DataFrame:
    vector = retrieve.top_k(*_vectors(spark, d), 100).select("query_id", "item_id", "score")
    return relevance.best(relevance.recency_blend(vector), "query_id", "item_id", 5)


def related_documents(spark: SparkSession, d: str) -> DataFrame:
    return relevance.related_best(archive.documents(spark, d), F.col("id") % 50 == 0, 5)


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return relevance.hash_embedding(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _current(spark: SparkSession, d: str) -> DataFrame:
    v = archive.versions(spark, d)
    return state.resolve(v, archive.claims(v), NOW).where("status in ('CURRENT', 'CONFLICTING')")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each key, conflicts first, until the first that does not fit in 120 characters."""
    c = _current(spark, d).withColumn("request", F.concat_ws("/", "corpus_id", "key"))
    out = relevance.prefix_budget(c, "request", [F.col("status"), F.desc("val"), F.col("claim_id")], F.length("claim"), 120)
    return out.select("request", "claim_id", "used")


def pack_budget(spark: SparkSession, d: str) -> DataFrame:
    c = _current(spark, d).select(F.concat_ws("/", "corpus_id", "key").alias("request"), F.col("claim_id").alias("id"), F.col("val").alias("score"), F.length("claim").alias("size"))
    return relevance.skip_budget(c, "request", 120)


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = archive.versions(spark, d)
    return v, archive.with_topic_edges(archive.claims(v))


def ingest_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(_edges(spark, d)[1])


def successor_heads(spark: SparkSession, d: str) -> DataFrame:
    return graph.heads(_edges(spark, d)[1])


def _live(v: DataFrame) -> DataFrame:
    return state.latest_versions(v).where("event <> 'DELETED'").select("version_id")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """References kept since an early instant, some of them to claims that never were."""
    v, c = _edges(spark, d)
    claim = F.when(F.col("val") % 50 == 0, F.concat("claim_id", F.lit("x"))).otherwise(F.col("claim_id"))
    return graph.revalidate(c.where(F.col("observed_at") <= state.instant(EARLY)).select(F.col("doc_id").alias("artifact"), claim.alias("claim_id")), c, _live(v))


def revalidate(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)


def revalidate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return graph.verdicts(_checked(spark, d))


def proof_digests(spark: SparkSession, d: str) -> DataFrame:
    return graph.proofs(archive.claims(archive.versions(spark, d))).select("version_id", "n_claims", "digest")


def verify_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Some given proofs have a changed body, others name no version."""
    v = archive.versions(spark, d)
    c = archive.claims(v)
    given = graph.proofs(c).select(F.when(F.col("version_id") % 13 == 0, -F.col("version_id") - 1).otherwise(F.col("version_id")).alias("version_id"), F.when(F.col("version_id") % 10 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")).alias("body"), "digest")
    return graph.verify_proofs(given, c, v, _live(v))


def pack_problems(spark: SparkSession, d: str) -> DataFrame:
    """A pack that lacks some claims and some evidence."""
    c = archive.claims(archive.versions(spark, d))
    held, e = c.where("val % 40 <> 0").select("claim_id"), archive.evidence(c).where("val % 30 <> 0").select("claim_id")
    missing, orphan = held.join(e, "claim_id", "left_anti"), e.join(held, "claim_id", "left_anti")
    return missing.select("claim_id", F.lit("missing_evidence").alias("problem")).union(orphan.select("claim_id", F.lit("orphan_evidence")))


def append_only_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an early state that a later one, in which some were changed, no longer holds."""
    v = archive.versions(spark, d).select("version_id", "doc_id", "event", "fp", "observed_at")
    later = v.withColumn("fp", F.when(F.col("version_id") % 97 == 0, F.lit("changed")).otherwise(F.col("fp")))
    return v.where(F.col("observed_at") <= state.instant(EARLY)).drop("observed_at").exceptAll(later.drop("observed_at"))


def plain_text(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    title = F.coalesce(F.substring(F.trim(F.get(lines, F.lit(0))), 1, 120), F.lit(""))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), F.sha2(F.concat(F.lit("# "), title, F.lit("\n\n"), "text"), 256).alias("digest"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown: a heading a turn, its text, and by turn a fence, a table or a list."""
    t, none = F.col("turn"), F.array().cast("array<string>")
    lines = F.concat(
        F.when(t % 4 == 0, F.array(F.concat(F.lit("# Part "), t.cast("string")))).otherwise(none),
        F.array(F.concat(F.lit("## "), "role", F.lit(" "), t.cast("string")), F.lit("")),
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        F.when(t % 3 == 1, F.array(F.lit("```"), F.lit("# code"), F.lit("```"), F.lit("### Notes"))).otherwise(none),
        F.when(t % 3 == 2, F.array(F.lit("| role | turn |"), F.lit("|---|---|"), F.concat(F.lit("| "), "role", F.lit(" | "), t.cast("string"), F.lit(" |")))).otherwise(none),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.concat(F.lit("- "), "role"), F.lit("- said"), F.lit("- said"))).otherwise(none),
    )
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "pos"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(lines).alias("pos", "line")).select("doc_id", order.alias("line_no"), "line")


def _pathed(spark: SparkSession, d: str) -> DataFrame:
    return markdown.heading_paths(markdown.kinds(_lines(spark, d)))


def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    return markdown.kinds(_lines(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"))


def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return _pathed(spark, d).where("kind <> 'blank'").select("doc_id", "line_no", "path")


def table_claims(spark: SparkSession, d: str) -> DataFrame:
    return markdown.table_rows(markdown.kinds(_lines(spark, d)))


def list_statements(spark: SparkSession, d: str) -> DataFrame:
    return markdown.statements(_pathed(spark, d))


def normative_prose(spark: SparkSession, d: str) -> DataFrame:
    p = _pathed(spark, d)
    return markdown.normative(p, markdown.statements(p), "(^| )(nicht|the|que)( |$)").select("doc_id", "line_no", "position", F.sha2("sentence", 256).alias("digest"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("quality is not null").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def label_set_scores(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).withColumnRenamed("doc_id", "item")
    return evaluate.set_scores(x.where("quality = 1"), x.where("n_chars >= 400"), "source")


def outcome_rollup(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).select("lang", "source", (F.col("n_chars") >= 100).alias("answered"), ((F.col("n_chars") >= 400) == (F.col("quality") == 1)).alias("right"))
    return evaluate.outcomes(x, "lang", "source")


def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bootstrap(table(spark, d, "events"), "event_type", "event_id", "value")


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """A second run whose clicks are worse and whose other values move both ways."""
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    other = F.when(F.col("event_type") == "click", F.col("value") - 1).otherwise(F.col("value") + F.pmod(F.xxhash64("event_id"), F.lit(3)) - 1)
    return evaluate.regression_gate(e, e.withColumn("value", other), "event_type", "event_id", "value")


def _feed(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))  # a pattern: a table may be one file


def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    folder = activity.new_folder(spark)
    writes = archive.candidate_writes(table(spark, d, "events")).select("user_id", "version_id", "observed_at", "fp")
    writes.write.parquet(f"{folder}/in")
    return activity.drain(lifecycle.lifecycle(spark.readStream.schema(writes.schema).parquet(f"{folder}/in")), folder)


def stream_feed(spark: SparkSession, d: str) -> DataFrame:
    """The feed delivered twice."""
    twice = _feed(spark, d).union(_feed(spark, d))
    return activity.drain(lifecycle.exactly_once(twice, "event_id", "2 hours").select("event_id", "user_id", "event_type"), activity.new_folder(spark))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.latest(_feed(spark, d), ["user_id", "event_type"], "value", activity.new_folder(spark))


def _terms_sql(text: str) -> str:
    cuts = " ".join(f"when ends_with(t, '{s}') and length(t) > {len(s) + 3} then left(t, length(t) - {len(s)})" for s in relevance.SUFFIXES)
    words = f"list_filter(regexp_extract_all(lower({text}), '[a-z][a-z0-9]+'), lambda t: t not in {tuple(relevance.STOP)})"
    return f"unnest(list_distinct(list_transform({words}, lambda t: case {cuts} else t end)))"


_SCORES = f"""with q as (select item_id question_id, {_terms_sql('text')} term from benchmark), d as (select doc_id, {_terms_sql('text')} term from documents),
f as (select term, count(*) df from d group by 1), w as (select question_id, q.term, ln(((select count(*) from documents) + 1) / (coalesce(df, 0) + 1.0)) + 1 idf from q left join f on f.term = q.term),
t as (select question_id, sum(idf) total from w group by 1), sc as (select w.question_id, doc_id, round(sum(idf) / any_value(total), 6) score from w join d on d.term = w.term join t on t.question_id = w.question_id group by all),
r as (select *, row_number() over (partition by question_id order by score desc, doc_id) as rank from sc)
"""
_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower(coalesce(left(trim(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1]), 120), '')), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_LISTS = f"""with g as (select doc_id, {_GRAMS} g from documents), x as (select doc_id, len(g) n, unnest(g) gram from g),
k0 as (select a.doc_id query_id, b.doc_id item_id, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) score from x a join x b on a.gram = b.gram where a.doc_id % 50 = 0 and b.doc_id <> a.doc_id group by all),
k as (select * from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from k0) where rank <= 100),
v0 as (select q.vec_id query_id, i.vec_id item_id, round(list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda z: cast(z[1] as double) * cast(z[2] as double))), 6) score from embeddings q, embeddings i where q.vec_id % 50 = 0 and i.vec_id <> q.vec_id),
v as (select * from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from v0) where rank <= 100)
"""
_CURRENT = status_sql(NOW) + ", cur as (select *, corpus_id || '/' || key request from s where status in ('CURRENT', 'CONFLICTING'))"
_WALK = EDGES_SQL.replace("with fx_ev", "with recursive fx_ev", 1)
_LATEST = ", live as (select version_id from (select *, row_number() over (partition by doc_id order by version_number desc) r from v) x where r = 1 and event <> 'DELETED')"
_CHECKED = EDGES_SQL + _LATEST + f""", refs as (select doc_id artifact, case when val % 50 = 0 then claim_id || 'x' else claim_id end claim_id from cx where observed_at <= timestamp '{EARLY}'),
checked as (select artifact, refs.claim_id, case when cx.claim_id is null then 'missing' when refs.claim_id in (select supersedes_id from cx where supersedes_id is not null) then 'superseded' when cx.version_id not in (select version_id from live) then 'retired' else 'current' end state from refs left join cx on cx.claim_id = refs.claim_id)
"""
_PROOFS = ARCHIVE_SQL + """, p as (select version_id, '[' || string_agg('{"key":"' || key || '","val":' || val || '}', ',' order by key) || ']' body, count(*) n_claims from c group by 1)
"""
_MD = """with m as (select conv_id, turn, (case when turn % 4 = 0 then ['# Part ' || turn] else [] end) || ['## ' || role || ' ' || turn, ''] || string_split(coalesce(text, ''), chr(10))
 || (case when turn % 3 = 1 then ['```', '# code', '```', '### Notes'] else [] end) || (case when turn % 3 = 2 then ['| role | turn |', '|---|---|', '| ' || role || ' | ' || turn || ' |'] else [] end)
 || (case when conv_id % 2 = 0 then ['- ' || role, '- said', '- said'] else [] end) l from conversations),
md as (select conv_id doc_id, row_number() over (partition by conv_id order by turn, i) line_no, line from (select conv_id, turn, unnest(l) line, unnest(range(len(l))) i from m)),
k as (select *, case when line like '```%' or inside then 'block' when regexp_matches(line, '^#{1,6} ') then 'heading' when line like '|%' then 'table' when line like '- %' then 'bullet' when trim(line) = '' then 'blank' else 'prose' end kind
 from (select *, sum(case when line like '```%' then 1 else 0 end) over (partition by doc_id order by line_no) % 2 = 1 inside from md)),
lv as (select *, case when kind = 'heading' then length(regexp_extract(line, '^(#+)', 1)) end lvl, regexp_replace(line, '^#+ ', '') t from k),
h as (select *, last_value(case when lvl = 1 then line_no end ignore nulls) over w n1, last_value(case when lvl = 2 then line_no end ignore nulls) over w n2, last_value(case when lvl = 3 then line_no end ignore nulls) over w n3,
 last_value(case when lvl = 1 then t end ignore nulls) over w t1, last_value(case when lvl = 2 then t end ignore nulls) over w t2, last_value(case when lvl = 3 then t end ignore nulls) over w t3 from lv window w as (partition by doc_id order by line_no)),
p as (select *, concat_ws(' > ', t1, case when n2 > coalesce(n1, -1) then t2 end, case when n3 > coalesce(n2, -1) and n3 > coalesce(n1, -1) then t3 end) path from h)
"""
_LABELLED = "with x as (select doc_id, quality, lang, source, n_chars from labels join documents using (doc_id) where quality is not null)"
ORACLES = {
    "relevance_top": _SCORES + "select question_id, doc_id, score, rank from r where rank <= 3",
    "adjudication": _SCORES + ", a as (select b.item_id question_id, x.doc_id, x.score top, round(x.score - coalesce(y.score, 0), 6) margin from benchmark b left join r x on x.question_id = b.item_id and x.rank = 1 left join r y on y.question_id = b.item_id and y.rank = 2) select question_id, case when top is null or top < 0.65 then 'abstained' when margin < 0.05 then 'ambiguous' else 'confident' end outcome, case when top >= 0.65 then doc_id end doc_id, margin from a",
    "title_similarity": _LISTS + "select query_id, item_id, score, rank from k where rank <= 10",
    "hybrid_search": _LISTS + """, ids as (select doc_id id from documents intersect select vec_id from embeddings),
kw as (select *, row_number() over (partition by query_id order by w desc, item_id) rk from (select q.id query_id, i.id item_id, coalesce(k0.score, 0) w from ids q join ids i on q.id % 50 = 0 and i.id <> q.id left join k0 on k0.query_id = q.id and k0.item_id = i.id)),
vw as (select *, row_number() over (partition by query_id order by score desc, item_id) rv from v0 where query_id in (from ids) and item_id in (from ids)),
j as (select query_id, item_id, round(1 / (60.0 + rv) + 1 / (60.0 + rk), 9) score, round(cast(0.7 as double) * vw.score + cast(0.3 as double) * w, 8) blend from vw join kw using (query_id, item_id)) select * from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from j) where rank <= 5""",
    "recency_search": _LISTS + ", b as (select query_id, item_id, round(cast(0.7 as double) * score + cast(0.3 as double) * percent_rank() over (partition by query_id order by item_id), 8) score from v) select * from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from b) where rank <= 5",
    "related_documents": _DOCS + ", t as (select corpus_id, id, unnest(list_distinct(tags)) tag from docs), n as (select a.id query_id, b.id, count(*) score from t a join t b on a.corpus_id = b.corpus_id and a.tag = b.tag and a.id <> b.id where a.id % 50 = 0 group by all) select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from n) where rank <= 5",
    "hash_embedding": "with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) token from documents), n as (select doc_id, cast(('0x' || left(sha256(token), 8)) as bigint) % 384 bucket, count(*) n from t group by all) select doc_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) weight from n",
    "context_budget": _CURRENT + " select request, claim_id, used from (select *, cast(sum(length(claim)) over (partition by request order by status, val desc, claim_id rows unbounded preceding) as bigint) used from cur) where used <= 120",
    "ingest_levels": _WALK + ", up as (select claim_id, 0 lvl, supersedes_id nxt from cx union all select u.claim_id, lvl + 1, x.supersedes_id from up u join cx x on x.claim_id = u.nxt) select claim_id, max(lvl) as level from up group by 1",
    "successor_heads": _WALK + ", gone as (select distinct supersedes_id from cx where supersedes_id is not null), down as (select claim_id, claim_id cur from cx where claim_id in (from gone) union all select d.claim_id, x.claim_id from down d join cx x on x.supersedes_id = d.cur) select claim_id, cur head_id from down where cur not in (from gone)",
    "revalidate": _CHECKED + "select artifact, claim_id, state from checked",
    "revalidate_verdicts": _CHECKED + "select artifact, case when bool_and(state = 'current') then 'CURRENT' else 'STALE' end verdict, count(*) filter (where state <> 'current') n_stale from checked group by 1",
    "proof_digests": _PROOFS + "select version_id, n_claims, sha256(body) digest from p",
    "verify_proofs": _PROOFS + _LATEST + ", x as (select version_id % 13 <> 0 known, version_id % 10 <> 0 intact, version_id % 13 <> 0 and version_id in (select version_id from live) in_force, case when version_id % 13 = 0 then -version_id - 1 else version_id end version_id from p) select version_id, intact, known, known agrees, in_force, concat_ws(',', case when not intact then 'intact' end, case when not known then 'known' end, case when not known then 'agrees' end, case when not in_force then 'in_force' end) failed from x",
    "pack_problems": ARCHIVE_SQL + "select claim_id, 'missing_evidence' problem from c where val % 40 <> 0 and val % 30 = 0 union all select claim_id, 'orphan_evidence' from c where val % 40 = 0 and val % 30 <> 0",
    "append_only_audit": ARCHIVE_SQL + f"select version_id, doc_id, event, fp from v where version_id % 97 = 0 and observed_at <= timestamp '{EARLY}'",
    "plain_text": "with x as (select doc_id, text, coalesce(left(trim(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1]), 120), '') title from documents) select doc_id, title, sha256('# ' || title || chr(10) || chr(10) || text) digest from x",
    "line_kinds": _MD + "select doc_id, kind, count(*) n, cast(sum(line_no) as bigint) lines from k group by all",
    "heading_paths": _MD + "select doc_id, line_no, path from p where kind <> 'blank'",
    "table_claims": _MD + "select doc_id, line_no, 'role: ' || trim(split_part(line, '|', 2)) || '; turn: ' || trim(split_part(line, '|', 3)) claim from k where kind = 'table' and line not in ('| role | turn |', '|---|---|')",
    "list_statements": _MD + "select doc_id, path, trim(line[3:]) as statement, min(line_no) line_no from p where kind = 'bullet' group by all",
    "normative_prose": _MD + r", z as (select doc_id, line_no, string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) l from k where kind = 'prose' and doc_id % 2 <> 0), y as (select doc_id, line_no, unnest(l) sentence, unnest(range(len(l))) as position from z) select doc_id, line_no, position, sha256(sentence) digest from y where regexp_matches(sentence, '(^| )(nicht|the|que)( |$)')",
    "label_set_scores": _LABELLED + ", y as (select source, quality = 1 e, n_chars >= 400 a from x), z as (select source, count(*) filter (where e and a) hits, count(*) filter (where e and not a) missing, count(*) filter (where a and not e) unexpected from y where e or a group by 1) select *, round(hits / nullif(hits + missing, 0), 6) recall, missing + unexpected = 0 exact from z",
    "outcome_rollup": _LABELLED + ", y as (select lang, source, n_chars >= 100 a, (n_chars >= 400) = (quality = 1) r from x) select lang, source, count(*) n, round(avg((a and r)::int), 6) correct, round(avg((a and not r)::int), 6) confident_wrong, round(avg((not a)::int), 6) abstained from y group by rollup (lang, source)",
    "stream_lifecycle": ARCHIVE_SQL + "select doc_id, version_id, version_number, predecessor_id, event, fp from v",
    "stream_feed": "select event_id, user_id, event_type from events",
    "stream_latest": "select user_id, event_type, max_by(value, ts) as value from events group by all",
}
ORACLES["pack_budget"] = _CURRENT.replace("with fx_ev", "with recursive fx_ev", 1) + """, o as (select request, claim_id id, length(claim) size, row_number() over (partition by request order by val desc, claim_id) i from cur),
w(request, i, room, id, size, k) as (select distinct request, cast(0 as bigint), cast(120 as bigint), cast(null as varchar), cast(null as bigint), cast(0 as bigint) from o union all
 select o.request, o.i, case when o.size <= room then room - o.size else room end, case when o.size <= room then o.id end, o.size, k + case when o.size <= room then 1 else 0 end from w join o on o.request = w.request and o.i = w.i + 1)
select request, id, size, k as rank from w where id is not null"""
ROWS_ONLY = ("bootstrap_mean", "regression_gate")  # order-dependent or resampled: tests/test_answers.py
QUERIES = {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}
