"""Registered queries of Markdown extraction and frontmatter, with the same results as DuckDB SQL.

Documents become Markdown line by line: by its place, a line stands as heading, item, wrapped line, field, numbered item,
fence, table, code, definition, quote or prose; every third document is prose alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import chunking, extraction, frontmatter
from palimpsest.plans.matching import pick, pick_sql
from palimpsest.sources.archive import table

# what stands before and after a line, by (its number + doc_id) % 14; None takes the line away
SHAPES = (("# ", ""), ("- ", ""), ("  ", ""), ("Owner: ", ""), ("7. ", " and"), ("", ""), ("```\n- ", "\n~~~\n```"), ("| name | size | |\n|---|:-:|---|\n| ", " | 5 | x |\n| idle state | - | ✓ |\n| a  | | b |"), ("### ", " ##"), ("    - ", ""), ("[x]: ", ""), ("It must hold. ", " of"), ("> ", ""), ("---\n  Key: ", ""))


def _body(spark: SparkSession, d: str) -> DataFrame:
    def shaped(line, i):
        k = F.pmod(i + F.col("doc_id"), F.lit(len(SHAPES))).cast("int")
        before, after = (pick(tuple(s[side] for s in SHAPES), k) for side in (0, 1))
        plain = F.when(F.pmod(i, F.lit(3)) == 0, F.concat(F.lit("It must hold. "), line)).otherwise(line)
        return F.when((F.trim(line) == ""), line).when(F.col("doc_id") % 3 == 0, plain).otherwise(F.concat(before, line, after))

    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), shaped), "\n").alias("body"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return extraction.scanned(extraction.body_lines(_body(spark, d)))


def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).where("kind <> 'blank'").select("doc_id", "line_no", "kind", F.sha2("path", 256).alias("path"))


def markdown_statements(spark: SparkSession, d: str) -> DataFrame:
    return extraction.statements(_scanned(spark, d)).select("doc_id", "line_no", "n_lines", F.sha2("claim", 256).alias("claim"), F.sha2("value", 256).alias("value"))


def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    return extraction.table_rows(_scanned(spark, d)).select("doc_id", "line_no", F.sha2("claim", 256).alias("claim"), F.sha2("quote", 256).alias("quote"))


def markdown_claims(spark: SparkSession, d: str) -> DataFrame:
    """Statements and rows with their keys, the first of equal ones under a heading."""
    return extraction.structural_claims(durable(_scanned(spark, d))).select("doc_id", "line_no", "key")


def markdown_prose(spark: SparkSession, d: str) -> DataFrame:
    """Rules in the prose of documents without other claims, and how many sentences of each said none."""
    lines = durable(_scanned(spark, d))
    sentences = durable(extraction.prose_sentences(lines, extraction.any_claims(lines)))
    rules = extraction.prose_claims(sentences).groupBy("doc_id").agg(F.count("*").alias("rules"), F.sum(F.length("claim")).alias("chars"), F.max("key").alias("key"))
    return rules.join(extraction.skipped(sentences), "doc_id", "full").select("doc_id", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("chars", F.lit(0)).alias("chars"), "key", F.coalesce("skipped", F.lit(0)).alias("skipped"))


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_chunks(_body(spark, d))


def quoted_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that a chunk of their document holds: all, as no statement is cut, but for those longer than a chunk."""
    b = _body(spark, d)
    return extraction.structural_claims(extraction.scanned(extraction.body_lines(b)), chunking.markdown_chunks(b)).drop("path")


def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.heading_chunks(_body(spark, d))


# (frontmatter, title, keys, code, line, field); the body follows. The first document has none, the second one that never closes.
FRONTS = (
    ("", None, 0, None, None, None),
    ("---\ntitle: Open\n", None, 0, None, None, None),
    ("---\ntitle: Plain\ntags: [a, b]\n---\n", "Plain", 2, None, None, None),
    ("---\n# note\ntitle: 'Quoted: one'\ndate: 2024-01-05\ntags:\n  - x\n  - y\nmeta:\n  deep: 1\n---\n", "Quoted: one", 4, None, None, None),
    ("---\nsupersedes: old.md\n---\n# Named here #\n", "Named here", 1, None, None, None),
    ("---\nstatus: active\n---\n", None, 1, "frontmatter_missing_title", None, "title"),
    ("---\ntitle: A\n\tbad: tab\n---\n", None, 0, "frontmatter_unparseable", 2, ""),
    ("---\ntitle: A: B\n---\n", None, 0, "frontmatter_unparseable", 1, ""),
    ("---\ntitle: A\n\nlist: [a, b\n---\n", None, 0, "frontmatter_unparseable", 3, ""),
    ("---\n- lost\ntitle: A\n---\n", None, 0, "frontmatter_unparseable", 1, ""),
    ("---\ntitle: A\ndate: soon\ntags: one\n---\n", "A", 3, "frontmatter_invalid_field", None, "date"),
    ("---\ntitle: A\nsummary: 7\nstatus: true\n---\n", "A", 3, "frontmatter_invalid_field", None, "status"),
    ("---\ntitle: 42\n---\n", "42", 1, "frontmatter_missing_title", None, "title"),
    ("---\ntitle: A\nclaims: none yet\n---\n", "A", 2, "claims_not_a_list", None, "claims"),
)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(pick(tuple(f[0] for f in FRONTS), F.col("doc_id")), "text").alias("raw"))


def frontmatter_documents(spark: SparkSession, d: str) -> DataFrame:
    return frontmatter.documents(_raw(spark, d), lambda body: F.sha2(body, 256)).select("doc_id", "title", F.size("keys").alias("n_keys"), "body")


def frontmatter_warnings(spark: SparkSession, d: str) -> DataFrame:
    return frontmatter.warnings(_raw(spark, d))


_S = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_FLAT = lambda x: _S(f"regexp_replace({x}, '\\s+', ' ', 'g')")
_STR = lambda x: "'" + x.replace("'", "''") + "'"
_WORD = "lower(regexp_extract({}, '([A-Za-z]+)[^A-Za-z]*$', 1))"
_LINES = rf"""with raw as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when trim(x, ' ') = '' then x
  when doc_id % 3 = 0 then case when (i - 1) % 3 = 0 then 'It must hold. ' || x else x end
  else {pick_sql(tuple(s[0] for s in SHAPES), "i - 1 + doc_id")} || x || {pick_sql(tuple(s[1] for s in SHAPES), "i - 1 + doc_id")} end), chr(10)) body from documents where text is not null),
l0 as (select doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) line_no from (select doc_id, regexp_split_to_array(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '\r\n|\r|\n') l from raw) x),
l1 as (select *, regexp_matches(line, '^\s{{0,3}}(```|~~~)') or sum(case when regexp_matches(line, '^\s{{0,3}}```') then 1 else 0 end) over (partition by doc_id order by line_no) % 2 = 1 fence from l0),
l2 as (select *, not fence and regexp_matches(line, '{extraction.PIPE}') pipe, not fence and regexp_matches(line, '{extraction.SEPARATOR}') sep from l1),
l3 as (select *, pipe and coalesce(lead(sep) over (partition by doc_id order by line_no), false) head, sum(case when pipe then 0 else 1 end) over (partition by doc_id order by line_no) run from l2),
l4 as (select *, case when pipe then min(case when head then line_no end) over (partition by doc_id, run order by line_no) end tab from l3),
l5 as (select *, case when fence or regexp_matches(line, '{extraction.RULE}') or regexp_matches(line, '{extraction.DEFINITION}') then 'block' when tab is not null then 'table' when pipe or regexp_matches(line, '{extraction.CODE}') then 'block'
  when regexp_matches(line, '{extraction.HEADING}') then 'heading' when {_S("line")} = '' then 'blank' else 'prose' end kind from l4),
l6 as (select *, case when kind = 'heading' then length(regexp_extract(line, '{extraction.HEADING}', 1)) end lv, regexp_extract(line, '{extraction.HEADING}', 2) ti from l5),
l7 as (select *, max(case when lv = 1 then line_no end) over w h1, max(case when lv = 3 then line_no end) over w h3 from l6 window w as (partition by doc_id order by line_no)),
s as (select x.*, concat_ws(' > ', a.ti, b.ti) path from l7 x left join l6 a on a.doc_id = x.doc_id and a.line_no = x.h1 left join l6 b on b.doc_id = x.doc_id and b.line_no = x.h3 and x.h3 > coalesce(x.h1, 0))
"""
_CLAIM_OK = f"length({_S('claim')}) >= 12 and not regexp_matches({_S('claim')}, '^(```|~~~)') and (length(claim) - length(replace(claim, '](', ''))) / 2 <= 2"
_STATEMENTS = (
    _LINES
    + rf""", p0 as (select *, sum(case when kind <> 'prose' then 1 else 0 end) over (partition by doc_id order by line_no) part from s),
p1 as (select *, regexp_matches(line, '{extraction.ITEM}') and not regexp_matches(line, '{extraction.TICK}') item, regexp_matches(line, '^\s') ind from p0 where kind = 'prose'),
p2 as (select *, not item and regexp_matches({_S("line")}, '{extraction.FIELD}') field from p1),
p3 as (select *, last_value(case when item then true when field and not ind then false end ignore nulls) over (partition by doc_id, part order by line_no) under from p2),
p4 as (select *, item or (field and not (ind and coalesce(under, false))) start from p3),
p5 as (select *, sum(start::int) over (partition by doc_id, part order by line_no) no from p4),
p6 as (select *, first_value(field) over w own, lag({_WORD.format("line")} in {extraction.UNFINISHED}) over w unfinished from p5 where no > 0 window w as (partition by doc_id, part, no order by line_no)),
p7 as (select *, max(case when own and not start and regexp_matches(line, '^[A-Z]') and not coalesce(unfinished, false) then 1 else 0 end) over (partition by doc_id, part, no order by line_no) over_ from p6),
p8 as (select doc_id, part, no, min(line_no) line_no, count(*) n_lines, arg_min(path, line_no) path, arg_min(field, line_no) field, list(line order by line_no) ls from p7 where over_ = 0 group by doc_id, part, no),
p9 as (select *, case when field then regexp_replace(ls[1], '^\s+', '') else regexp_replace(ls[1], '{extraction.ITEM}', '') end hd from p8 where not (field and regexp_matches(ls[1], '{extraction.DECLARATION}'))),
st as (select doc_id, path, line_no, n_lines, regexp_replace(array_to_string(list_prepend(hd, ls[2:]), chr(10)), '\s+$', '') claim,
  array_to_string(list_filter(list_prepend(case when field and contains({_FLAT("hd")}, ': ') then substr({_FLAT("hd")}, strpos({_FLAT("hd")}, ': ') + 2) else {_FLAT("hd")} end, list_transform(ls[2:], lambda t: {_FLAT("t")})), lambda t: t <> ''), ' ') as value from p9)
"""
)
_CELLS = lambda x: f"list_transform(string_split(regexp_replace(regexp_replace({_S(x)}, '^\\|', ''), '\\|$', ''), '|'), lambda c: {_S('c')})"
_ROWS = rf""", t0 as (select x.doc_id, x.path, x.line_no, x.line quote, {_CELLS("x.line")} c, {_CELLS("h.line")} n from s x join s h on h.doc_id = x.doc_id and h.line_no = x.tab where x.kind = 'table' and x.line_no > x.tab + 1),
t1 as (select *, list_filter(list_transform(range(2, len(c) + 1), lambda i: [coalesce(n[i], ''), c[i]]), lambda p: p[2] <> '') sp, list_filter(list_transform(range(2, len(c) + 1), lambda i: coalesce(n[i], '')), lambda x: x <> '') nm from t0),
t2 as (select *, array_to_string(list_transform(list_filter(sp, lambda p: p[1] <> ''), lambda p: p[1] || ': ' || p[2]), '; ') told, len(list_filter(sp, lambda p: translate(p[2], '{extraction.STATUS_MARKS}', '') <> '')) facts from t1),
tr as (select doc_id, path, line_no, quote, case when told = '' then c[1] when c[1] = '' then told else c[1] || ': ' || told end claim from t2 where len(nm) > 0 and not (len(sp) > 0 and facts = 0))
"""
_CLAIMS = (
    _STATEMENTS
    + _ROWS
    + f""", al as (select doc_id, path, line_no, claim, '' kind from st where {_CLAIM_OK} union all select doc_id, path, line_no, claim, ':table' from tr where {_CLAIM_OK}),
fi as (select * from (select *, row_number() over (partition by doc_id, path, claim order by line_no) k from al) x where k = 1),
sl as (select *, regexp_replace(left(regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), '^-+|-+$', '', 'g') stem from fi),
cl as (select doc_id, line_no, 'md:' || case when stem = '' then 'section' else stem end || '-' || left(sha256(path), 8) || kind || ':' || (row_number() over (partition by doc_id, path, kind order by line_no) - 1) as key from sl)
"""
)
_FRONT = f"with f as (select doc_id, text, {{}} from documents where text is not null)"
ORACLES = {
    "markdown_lines": _LINES + "select doc_id, cast(line_no as int) line_no, kind, sha256(path) path from s where kind <> 'blank'",
    "markdown_statements": _STATEMENTS + f"select doc_id, cast(line_no as int) line_no, n_lines, sha256(claim) claim, sha256(value) as value from st where {_CLAIM_OK}",
    "markdown_rows": _LINES + _ROWS + f"select doc_id, cast(line_no as int) line_no, sha256(claim) claim, sha256(quote) as quote from tr where {_CLAIM_OK}",
    "markdown_claims": _CLAIMS + "select doc_id, cast(line_no as int) line_no, key from cl",
    "markdown_prose": _CLAIMS
    + rf""", q0 as (select *, kind = 'prose' and not regexp_matches(line, '^\s*>') and not (regexp_matches(line, '{extraction.ITEM}') and not regexp_matches(line, '{extraction.TICK}')) inp from s where doc_id not in (select doc_id from cl)),
q1 as (select *, sum(case when inp then 0 else 1 end) over (partition by doc_id order by line_no) p from q0),
q2 as (select doc_id, min(line_no) line_no, string_agg(line, chr(10) order by line_no) t from q1 where inp group by doc_id, p),
q3 as (select doc_id, line_no, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) l from q2), q4 as (select doc_id, line_no, unnest(l) sentence, unnest(range(len(l))) pos from q3),
q5 as (select *, regexp_matches(lower(sentence), '(^|[^a-z0-9_])({"|".join(w.replace(chr(39), chr(39) * 2) for w in extraction.SIGNALS)})($|[^a-z0-9_])') as rule from q4 where length({_S("sentence")}) >= 12),
q6 as (select distinct doc_id, sentence from q5 where rule), q7 as (select doc_id, count(*) rules, cast(sum(length(sentence)) as bigint) chars, max('md:prose:' || n) as key from (select *, row_number() over (partition by doc_id) - 1 n from q6) x group by 1),
q8 as (select doc_id, count(*) skipped from q5 where not rule group by 1)
select doc_id, coalesce(rules, 0) rules, coalesce(chars, 0) chars, key, coalesce(skipped, 0) skipped from q7 full join q8 using (doc_id)""",
    "frontmatter_documents": _FRONT.format(f"{pick_sql(tuple(f[0] for f in FRONTS), 'doc_id')} front, {pick_sql(tuple(f[1] for f in FRONTS), 'doc_id')} title, [{', '.join(str(f[2]) for f in FRONTS)}][doc_id % {len(FRONTS)} + 1] n_keys")
    + f"select doc_id, title, cast(n_keys as int) n_keys, sha256({_S('case when n_keys = 0 then front || text when doc_id % 14 = 4 then ' + _STR('# Named here #') + ' || chr(10) || text else text end')}) body from f",
    "frontmatter_warnings": _FRONT.format(f"{pick_sql(tuple(f[3] for f in FRONTS), 'doc_id')} code, [{', '.join('null' if f[4] is None else str(f[4]) for f in FRONTS)}][doc_id % {len(FRONTS)} + 1] line, {pick_sql(tuple(f[5] for f in FRONTS), 'doc_id')} field")
    + "select doc_id, code, cast(line as int) line, field from f where code is not null",
}
ROWS_ONLY = ("markdown_chunks", "heading_chunks", "quoted_claims")  # sequential cuts: tests/test_markdown.py
QUERIES = {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}
