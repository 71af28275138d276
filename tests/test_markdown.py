"""Markdown extraction: golden cases of wrapped statements, tables, prose; chunks against a cutter on plain strings; frontmatter."""

import random
import re

import pytest

from palimpsest.operators import chunking, extraction, frontmatter
from palimpsest.plans import markdown

from .conftest import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def scan(spark, *bodies):
    return extraction.scanned(extraction.body_lines(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")))


def claims(spark, *bodies):
    return [(r.doc_id, r.claim, r.value) for r in sorted(extraction.statements(scan(spark, *bodies)).collect(), key=lambda r: (r.doc_id, r.line_no))]


def test_kinds_of_lines(spark):
    body = "# T\n```\n~~~\n- x\n```\nprose\n~~~\n```\n~~~\n    code\n\tcode\n---\n[a]: b\n| h | k |\n|:--|--:|\n| 1 | 2 |\n\n| no table\n***\n<!-- gone\n# gone -->#### Deep ##\n "
    got = [r.kind for r in sorted(scan(spark, body).collect(), key=lambda r: r.line_no)]
    assert got == ["heading", "block", "block", "block", "block", "prose", "block", "block", "block", "block", "block", "block", "block", "table", "table", "table", "blank", "block", "block", "heading", "blank"]


def test_paths_of_six_levels(spark):
    body = "x\n### C\nx\n# A\nx\n###### F\nx\n## B ##\nx\n#### D\nx\n#NoHeading"
    assert [(r.line_no, r.path) for r in sorted(scan(spark, body).collect(), key=lambda r: r.line_no) if r.kind == "prose"] == [(1, ""), (3, "C"), (5, "A"), (7, "A > F"), (9, "A > B"), (11, "A > B > D"), (12, "A > B > D")]


def test_wrapped_statements(spark):
    assert claims(spark, "- first line of it\n  wrapped here\nAnd even so here\n- second item, it is\n\nnot a statement at all") == [(0, "first line of it\n  wrapped here\nAnd even so here", "first line of it wrapped here And even so here"), (0, "second item, it is", "second item, it is")]
    assert claims(spark, "Owner: the team of\nPlatform and\nMore of it\nThe end of this") == [(0, "Owner: the team of\nPlatform and\nMore of it", "the team of Platform and More of it")]
    assert claims(spark, "Owner: the platform team\nThe next sentence\nis not part\n  Key: is a new field") == [(0, "Owner: the platform team", "the platform team"), (0, "Key: is a new field", "is a new field")]
    assert claims(spark, "- an item with prose\n  Note: this stays in it\nNote: this does not stay") == [(0, "an item with prose\n  Note: this stays in it", "an item with prose Note: this stays in it"), (0, "Note: this does not stay", "this does not stay")]
    assert claims(spark, "- [ ] a task is no statement\n1. numbered statement\n12) another numbered one\n- short", "- an item that ends here\n```\ncode\n```\nafter the block", "Supersedes: an-older.md\n- [a](b) [c](d) [e](f) links\n* starred statement") == [
        (0, "numbered statement", "numbered statement"), (0, "another numbered one", "another numbered one"), (1, "an item that ends here", "an item that ends here"), (2, "starred statement", "starred statement")]
    assert claims(spark, None, "", "\n\n") == []


def test_keys_of_claims(spark):
    lines = scan(spark, "# Doc\n- the same statement\n- the same statement\n- another statement\n\n| n | v |\n|---|---|\n| row label | 7 |\n| row other | - |\n\n## Sub\n- the same statement")
    got = sorted(extraction.structural_claims(lines).collect(), key=lambda r: r.line_no)
    assert [(r.line_no, re.sub("-[0-9a-f]{8}", "", r.key), r.claim) for r in got] == [(2, "md:doc:0", "the same statement"), (4, "md:doc:1", "another statement"), (8, "md:doc:table:0", "row label: v: 7"), (12, "md:doc-sub:0", "the same statement")]
    chunks = spark.createDataFrame([(0, "x another statement y"), (1, "the same statement")], "doc_id long, text string")
    assert [r.key[-2:] for r in extraction.structural_claims(lines, chunks).collect()] == [":0"]


def test_table_rows(spark):
    body = "| item | size |  | kind |\n|---|---|---|---|\n| a row of it | 5 | lost | red |\n| a row of it |  |  | ✓ |\n|  | 12 meters | | long |\n| only a label of it |\n| pipe | in | a | row | more |\n\n|  |  |\n|---|---|\n| a link that says | nothing |"
    assert [r.claim for r in sorted(extraction.table_rows(scan(spark, body)).collect(), key=lambda r: r.line_no)] == ["a row of it: size: 5; kind: red", "size: 12 meters; kind: long", "pipe: size: in; kind: row"]


def test_prose_rules_and_what_is_skipped(spark):
    lines = scan(spark, "All keys must be rotated. The sky is rather blue.\nWe don't log\npasswords here! Short.\n\n> You must not count quotes.\n\nAll keys must be rotated.", "- a statement of its own\n\nIt must hold here.")
    sentences = extraction.prose_sentences(lines, extraction.structural_claims(lines))
    assert [(r.doc_id, r.key, r.claim) for r in sorted(extraction.prose_claims(sentences).collect())] == [(0, "md:prose:0", "All keys must be rotated."), (0, "md:prose:1", "We don't log\npasswords here!")]
    assert rows(extraction.skipped(sentences)) == [(0, 1)]


# --- chunks ---------------------------------------------------------------------------------------------------------


def cut_strings(text, limit):
    """The cutter's rules on plain strings."""
    words, out = set(extraction.UNFINISHED), []
    if len(text) <= limit:
        return [text]
    held = ""
    for para in (p.strip() for p in text.split("\n\n")):
        while len(para) > limit:
            if held:
                out.append(held)
                held = ""
            head, at, item, starts = para[:limit], 0, False, []
            for line in head.split("\n"):
                if re.match(r"([-*+]|\d{1,3}[.)])\s+", line):
                    starts, item = [*starts, at], True
                elif re.match(r"[A-Za-z][A-Za-z0-9 _-]{0,40}:\s*\S", line.strip()) and not (item and line[:1].isspace()):
                    starts, item = [*starts, at], False
                at += len(line) + 1
            late = [x for x in starts if x > limit // 2]
            if late:
                head = para[: late[-1]]
            elif head.rfind("\n") > limit // 2:
                head = head[: head.rfind("\n")]
            elif head.rfind(" ") > limit // 2:
                head = head[: head.rfind(" ") + 1]
            letters = list(re.finditer("[A-Za-z]+", head))
            if letters and letters[-1][0].lower() in words:
                space = head.rfind(" ", 0, letters[-1].start())
                head = head[:space] if space > limit // 2 else head
            out.append(head.strip())
            para = para[len(head) :].lstrip()
        if held and len(held) + 2 + len(para) > limit:
            out.append(held)
            held = ""
        held = f"{held}\n\n{para}" if held and para else held or para
    return [*out, held] if held else out


@pytest.mark.parametrize("limit", [60, 200, 1200])
def test_prose_chunks_equal_string_cutting(limit):
    rng = random.Random(limit)
    pieces = ["and", "the word", "sentence. ", "\n\n", "\n", "- item", "  Key: value", "Key: value", "of", "\n \n\n", "12. number", "x" * 70, "é", " "]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randint(1, 120))).strip()
        found = list(chunking.chunks(text, limit))
        assert [c[2] for c in found] == cut_strings(text, limit)
        for _, _, chunk, a, b in found:
            assert re.sub(r"\s", "", text[a:b]) == re.sub(r"\s", "", chunk) and len(chunk) <= max(limit, 0)
        assert re.sub(r"\s", "", "".join(text[c[3] : c[4]] for c in found)) == re.sub(r"\s", "", text)


def test_sections_and_tables():
    body = "intro\n# A\n\ntext one\n| h | k |\n|---|---|\n| r1 | 1 |\n| r2 | 2 |\ntail\n## B\n# C\nlast"
    assert [(p, k, t) for p, k, t, *_ in chunking.chunks(body)] == [("", "prose", "intro"), ("A", "prose", "text one"), ("A", "table", "| h | k |\n|---|---|\n| r1 | 1 |\n| r2 | 2 |\nr1: k: 1\nr2: k: 2"), ("A", "prose", "tail"), ("A > B", "prose", ""), ("C", "prose", "last")]
    long = "# T\n| h | k |\n|---|---|\n" + "\n".join(f"| row {i} | {i} |" for i in range(100))
    found = list(chunking.chunks(long, 200))
    assert all(t.startswith("| h | k |\n|---|---|\n| row") and len(t) <= 200 for _, _, t, *_ in found)
    assert "\n".join(long[a:b] for *_, a, b in found) == long.split("---|\n", 1)[1]
    assert list(chunking.chunks("| a |\n|---|\n")) == [] and list(chunking.chunks(" \n\n")) == []


def test_registered_chunks(spark):
    d = SF
    chunks = markdown.markdown_chunks(spark, d).collect()
    bodies = {r.doc_id: r.body for r in markdown._body(spark, d).collect()}
    assert {r.doc_id for r in chunks} == {k for k, b in bodies.items() if b.strip()}
    for r in chunks:
        if r.kind == "prose":
            assert len(r.text) <= chunking.LIMIT and re.sub(r"\s", "", bodies[r.doc_id][r.start : r.end]) == re.sub(r"\s", "", r.text)
        else:
            assert bodies[r.doc_id][r.start : r.end] in r.text
    held = {(r.doc_id, r.key) for r in markdown.quoted_claims(spark, d).collect()}
    assert len(held) > 0.8 * markdown.markdown_claims(spark, d).count()
    texts = [r.text for r in markdown.heading_chunks(spark, d).collect()]
    assert re.sub(r"\s", "", "".join(sorted(texts))) and all(t.strip() == t and t for t in texts)


def test_heading_chunks(spark):
    df = spark.createDataFrame([(1, "a\nb\n# c\nd\n\n#e"), (2, "x" * 9 + "\n" + "y" * 9 + "\nz"), (3, None), (4, " ")], "doc_id long, body string")
    assert rows(chunking.heading_chunks(df, 12)) == [(1, 0, "a\nb"), (1, 1, "# c\nd"), (1, 2, "#e"), (2, 0, "x" * 9), (2, 1, "y" * 9 + "\nz")]
    assert chunking.markdown_chunks(df.limit(0)).count() == 0


# --- frontmatter ----------------------------------------------------------------------------------------------------


def test_frontmatter(spark):
    raw = ["---\ntitle: \"Q\"\ntags: []\n---\nbody\n", "no frontmatter\n---\nx\n---\n", "---\ntitle: A\ntags: [1]\n---\n", "---\ntitle: A\nsummary:\n  deep: 1\n---\nb", "---\nclaims:\n  - key: k\n    value: v\ntitle: A\n---\n", "---\n\n---\nempty block", None, "---\ntitle: 'open\n---\nb", "---\ndate: ~\ntitle: A\n---"]
    df = spark.createDataFrame(list(enumerate(raw)), "doc_id long, raw string")
    assert [(r.doc_id, r.title, r["keys"], r.body) for r in sorted(frontmatter.documents(df).collect())] == [
        (0, "Q", ["title", "tags"], "body"), (1, None, [], raw[1].strip()), (2, "A", ["title", "tags"], ""), (3, "A", ["title", "summary"], "b"), (4, "A", ["claims", "title"], ""), (5, None, [], "empty block"),
        (6, None, [], None), (7, None, [], raw[7]), (8, "A", ["date", "title"], "")]
    assert rows(frontmatter.warnings(df)) == [(2, "frontmatter_invalid_field", None, "tags"), (3, "frontmatter_invalid_field", None, "summary"), (7, "frontmatter_unparseable", 1, "")]
