"""What grows with the input alone: rows that steps make, and results that stay as they were."""

import os
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import extraction, frontmatter, select, texts
from palimpsest.plans import markdown
from palimpsest.sources import directory

from .conftest import SF


def most_rows(df):
    """Rows of the result, and the most that any step of its plan made."""
    out, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if "QueryStage" in name else []
        made, children = p.metrics().get("numOutputRows"), p.children()
        most = max(most, made.get().value() if made.isDefined() else 0)
        todo += [children.apply(i) for i in range(children.size())]
    return out, most


def test_references_do_not_meet_all_claims_of_a_shared_name(spark):
    n = 1000
    c = spark.range(n).select(F.lit("x").alias("corpus_id"), F.format_string("i%04d", "id").alias("claim_id"), F.lit("k").alias("key"), F.format_string("P%d.md", F.col("id") % 2).alias("path"))
    ref = F.element_at(F.array(*map(F.lit, ("k", "i0", "p1.MD", "i0007"))), (F.col("id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("key", "prefix", "path", "prefix"))), (F.col("id") % 4 + 1).cast("int"))
    out, most = most_rows(select.resolve_references(spark.range(n).select(F.col("id").alias("ref_id"), F.lit("x").alias("corpus_id"), kind.alias("kind"), ref.alias("ref")), c))
    assert {(r.ref_id % 4, r.n, r.outcome, r.claim_id) for r in out} == {(0, n, "ambiguous", None), (1, n, "ambiguous", None), (2, n // 2, "ambiguous", None), (3, 1, "resolved", "i0007")}
    assert len(out) == n and most <= 6 * n


def scans(df):
    """How often a query's plan reads its tables, after what it has stored by then."""
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


@pytest.mark.parametrize("name", ["markdown_prose", "markdown_claims"])
def test_lines_are_scanned_once(spark, name):
    assert scans(getattr(markdown, name)(spark, SF)) == 0


def test_lines_by_their_first_character(spark):
    """Guards that spare patterns take the same lines as the patterns by themselves."""
    odd = ["", " ", "\t", "\x0b\f", "| a", " \t| a", "\u00a0| a", "---", "  ***", "    ___", "-- -", "[x]: y", " [x]:", "```", "   ~~~", "    ~~~", "    code", "\tcode", "   text", "# h", "#h", " # h", "####### h", "a b", "9. x"]
    x = extraction.scanned(extraction.body_lines(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, body string")))
    line = F.col("line")
    want = F.when(line.rlike(extraction.FENCE) | line.rlike(extraction.RULE) | line.rlike(extraction.DEFINITION) | line.rlike(extraction.PIPE) | line.rlike(extraction.CODE), "block").when(line.rlike(extraction.HEADING), "heading").when(line.rlike(r"^\s*$"), "blank").otherwise("prose")
    assert x.where(F.col("kind") != want).collect() == [] and x.count() == len(odd)
    words = spark.createDataFrame([("",), ("one",), ("one two. ",), ("12 The\n",), ("é of é",), ("the 7\n7",), ("OF",), ("7",)], "t string")
    assert [r[0] for r in words.select(extraction.last_word(F.col("t"))).collect()] == ["", "one", "two", "the", "of", "the", "of", ""]
    assert [r.line for r in extraction.body_lines(spark.createDataFrame([(1, "a\r\nb\rc\n<!-- x\n -->d\r")], "doc_id long, body string")).orderBy("line_no").collect()] == ["a", "b", "c", "d", ""]


def test_fronts_end_where_their_second_mark_does(spark):
    """The block and what follows, as splitting all lines gives them."""
    odd = ["", "---", "---\n---", "---\n---\n", "---\n\n---\nx", "---\na: 1\n---", "---\r\na: 1\r\nb\r\r\n--- \t\r\nx\r\ny\rz\n---\n", "--- \na\n ---\n---x\n---\n\n", "x\n---\na\n---\n", "---\na: 1\n", "----\na\n---\n", "--- \na\n---\u0085\nb", "---\n---\n---\nc", "---\n\r\n---\n", None]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, raw string")
    lines = F.split("raw", r"\r\n|\n", -1)
    marks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^---\s*$"), i)), lambda i: i.isNotNull())
    second = F.get(marks, F.lit(1))
    there = (F.get(marks, F.lit(0)) == 0) & second.isNotNull()
    want = docs.select("doc_id", "raw", F.when(there, F.slice(lines, 2, second - 1)).alias("block"), F.when(there, F.array_join(F.slice(lines, second + 2, F.size(lines)), "\n")).alias("rest"))
    assert sorted(map(tuple, frontmatter.split_documents(docs).collect())) == sorted(map(tuple, want.collect()))


def test_digests_of_bodies_are_taken_before_texts_are_shuffled(spark):
    plan = markdown.frontmatter_documents(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan.split("Join")[0]


def test_a_sync_reads_its_files_for_fronts_and_for_bodies_only(spark, tmp_path):
    """Texts are read twice a batch, whatever the parts of a frontmatter are, and not at all when a batch runs again."""
    read = spark.sparkContext.accumulator(0)

    def content(parts):
        for part in parts:
            read.add(len(part))
            yield part

    files = spark.createDataFrame([(f"{i}.md", f"---\ntitle: T {i}\ntags: [a]\n---\n# H\n\nText {i}".encode()) for i in range(50)], "path string, content binary").repartition(2)
    store = str(tmp_path / "store")
    assert directory.ingest(store, 0, files.mapInPandas(content, files.schema), "k", delete_removed=False).where("outcome = 'added'").count() == 50
    first = read.value
    assert first <= 3 * 50  # with the rejects
    directory.ingest(store, 0, files.mapInPandas(content, files.schema), "k", delete_removed=False)
    assert read.value == first
    held = [len(os.listdir(f"{store}/{t}/data/batch=0/{b}")) for t in ("documents", "chunks") for b in os.listdir(f"{store}/{t}/data/batch=0") if b.startswith("bucket=")]
    assert max(held) <= 2  # a file and its checksum: a bucket is written by one task


def test_strip_is_that_of_patterns(spark):
    odd = ["", " ", "a", " \t\n\x0b\f\ra b\r\f\x0b\n\t ", "a \u0085", "a \u0085 ", "\u0085", "  ", "a\n \n ", "  a  ", "\x1c a \x1c", None]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for got, want in df.select(texts.strip(F.col("x")), F.regexp_replace("x", r"^\s+|\s+$", "")).collect():
        assert got == want


def test_lines_are_put_in_order_once(spark):
    """Rows of tables and statements are told apart by the lines where they begin, not in windows of their own."""
    bodies = spark.createDataFrame([(1, "- a first item here\n\n| a | b |\n|---|---|\n| c | d |\n")], "doc_id long, body string")
    plan = extraction.statements(extraction.scanned(extraction.body_lines(bodies)))._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?), line_no#\d+ ASC", plan)
    assert specs and all(re.fullmatch(r"doc_id#\d+L", s) for s in specs)
