"""Directories made the content of a stored index, statements remembered as documents."""

import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import frontmatter, merges, statements, texts
from palimpsest.sources import directory


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def write(root, **files):
    for name, content in files.items():
        path = root / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_a_directory_is_synced(spark, tmp_path):
    root, store = tmp_path / "notes of mine", str(tmp_path / "store")
    write(root, a_md="---\ntitle: A\ntags: x, y\n---\r\n# One\r\n\r\nFirst text.\r\n", sub__deep__b_md="# Two\n\nOther text.\n", c_txt="plain", sub__bad_md=b"\xff\xfe", e_md=" ", empty_md="")
    assert [r[0] for r in rows(directory.scan(spark, str(root)).select("path"))] == ["a.md", "e.md", "sub/bad.md", "sub/deep/b.md"]
    assert rows(directory.sync_directory(spark, store, 0, str(root), "k")) == [("a.md", "added", None), ("e.md", "added", None), ("sub/bad.md", "failed", "not_utf8"), ("sub/deep/b.md", "added", None)]
    docs = lambda: {r.path: r for r in merges.read(spark, f"{store}/documents", directory.DOCUMENTS).where("corpus_id = 'k'").collect()}
    chunks = lambda: rows(merges.read(spark, f"{store}/chunks", directory.CHUNKS).where("corpus_id = 'k'").select("path", "order_index", "heading_path", "text"))
    first = docs()
    assert (first["a.md"].title, first["a.md"].tags, first["a.md"].body) == ("A", ["x", "y"], "# One\n\nFirst text.") and first["sub/deep/b.md"].title == "b" and first["e.md"].body == ""
    assert [(c[0], c[1]) for c in chunks()] == [("a.md", 0), ("sub/deep/b.md", 0)] and "First text." in chunks()[0][3]

    directory.ingest(store, 1, spark.createDataFrame([("z.txt", b"kept apart")], "path string, content binary"), "other")
    write(root, a_md="# One\n\nSecond text.\n", sub__deep__b_md=b"\xff", f_md="# New\n\nNew text.\n")
    (root / "e.md").unlink()
    told = [("a.md", "changed", None), ("e.md", "deleted", None), ("f.md", "added", None), ("sub/bad.md", "failed", "not_utf8"), ("sub/deep/b.md", "failed", "not_utf8")]
    assert rows(directory.sync_directory(spark, store, 2, str(root), "k")) == told
    now = docs()
    assert set(now) == {"a.md", "f.md", "sub/deep/b.md"} and now["a.md"].id == first["a.md"].id and now["sub/deep/b.md"] == first["sub/deep/b.md"]
    assert [c[0] for c in chunks()] == ["a.md", "f.md", "sub/deep/b.md"] and "Second text." in chunks()[0][3]
    assert [r.title for r in merges.read(spark, f"{store}/documents", directory.DOCUMENTS).where("corpus_id = 'other'").collect()] == ["kept apart"]
    assert rows(directory.sync_directory(spark, store, 2, str(root), "k")) == told  # again: nothing is done twice
    assert docs() == now


def test_chunks_are_caught_up_after_a_failure(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    files = spark.createDataFrame([("a.md", b"# A\n\nSome text here."), ("a.md", b"# A\n\nSome text here.")], "path string, content binary")

    def dies(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(merges, "replace", dies)
        with pytest.raises(RuntimeError):
            directory.ingest(store, 0, files, "k")
    assert rows(directory.ingest(store, 0, files, "k")) == [("a.md", "added", None)]
    assert merges.read(spark, f"{store}/chunks", directory.CHUNKS).count() == 1


def test_formats(spark):
    files = [("x/a.PY", b"print(1)\n"), ("b.tar.gz", b"."), (".md", b"no name"), ("c.yaml", b"a: 1"), ("d.json", b'{"k": 1}'), ("e.json", b"[1]"), ("f.json", b"{"), ("g.txt", b"\r\n  First \rsecond"), ("h.txt", b" \n"), ("i.txt", None), ("j", b""), ("k.sql", b"\xc3")]
    docs, rejects = directory.dispatch(spark.createDataFrame(files, "path string, content binary"))
    assert rows(rejects) == [(".md", "unsupported"), ("b.tar.gz", "unsupported"), ("c.yaml", "unsupported"), ("i.txt", "not_utf8"), ("j", "unsupported"), ("k.sql", "not_utf8")]
    got = {r.path: r for r in docs.collect()}
    assert set(got) == {"x/a.PY", "d.json", "e.json", "f.json", "g.txt", "h.txt"}
    assert got["x/a.PY"][1:] == ("a.PY (python)", "note", ["code", "python"], "Source code file a.PY", "# a.PY\n\n```python\nprint(1)\n```\n")
    assert [got[f"{x}.json"].summary for x in "def"] == ["JSON document with keys: k", "JSON document", "JSON document (unparseable)"]
    assert got["d.json"].body == '# d\n\n```json\n{"k": 1}\n```\n' and got["g.txt"].body == "# First\n\nFirst \nsecond" and got["h.txt"].body == "# h\n\n"
    empty, none = directory.dispatch(spark.createDataFrame([], "path string, content binary"))
    assert empty.count() == none.count() == 0


def test_json_is_read_to_its_end(spark):
    bad = ['{"k": 1}!', '{"k": 1} {"l": 2}', "1, 2", "1], [2", "", " ", "{'k': 1}", '{"k": 1', '"a', '[1, "x"] x', None]
    good = ['{"k": [1, {"l": "]"}]}', " 1 ", '"a, \\"b"', "[]", "null", "\n{}\n"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bad + good)], "i int, x string")
    got = [r[0] for r in df.select("i", texts.json_summary(F.col("x")).alias("s")).orderBy("i").select("s").collect()]
    assert got == ["JSON document (unparseable)"] * len(bad) + ["JSON document with keys: k"] + ["JSON document"] * 5


DAY = datetime.date(2024, 5, 6)
ASK = "request_id long, corpus_id string, statement string, key string, scope string, state string, day date"


def test_statements_become_documents(spark):
    asks = [
        ("Uses\n PostgreSQL 16. Since May.", "db", None, None), ("## # Title: \"q\" \\ b", None, "a/b", "draft"), ("x", "a/b/k", "a/b", None), ("x", "a/bk", "a/b", None), ("x", " k ", None, "approved"), ("#", "k", None, None),
        (None, "k", None, None), ("x", "  ", None, None), ("y" * 4001, None, None, None), ("y" * 4000, None, None, None), ("x", None, None, "superseded"), *[("x", "k", s, None) for s in ("", "/a", "a/", "a//b", ".", "a/..", "a b", "a\n", "...")],
    ]
    r = statements.remembered(spark.createDataFrame([(i, "c", *a, DAY) for i, a in enumerate(asks)], ASK)).orderBy("request_id").collect()
    assert [x.reason for x in r] == [None] * 5 + ["statement_empty", "statement_empty", "key_blank", "statement_too_long", None, "invalid_state"] + ["invalid_scope"] * 8 + [None]
    assert [x.key for x in r[:1] + r[2:5]] == ["db", "a/b/k", "a/b/a/bk", "k"] and r[1].key.startswith("a/b/text:") and r[1].path.startswith("a/b/memory/a-b-text-") and all(x.raw is None and x.path is None for x in r if x.reason)
    said = "Uses PostgreSQL 16. Since May."
    assert r[0].raw == f'---\ntitle: "Uses PostgreSQL 16"\ndate: 2024-05-06\ndocument_type: note\nclaims:\n  - key: "db"\n    claim: "{said}"\n    value: "{said}"\n    evidence: "{said}"\n---\n\n# Uses PostgreSQL 16\n\n{said}\n'
    assert r[1].statement == '# Title: "q" \\ b' and "status: draft\n" in r[1].raw and "    info_state: draft\n" in r[1].raw and '"# Title: \\"q\\" \\\\ b"' in r[1].raw
    docs = frontmatter.documents(spark.createDataFrame([(0, r[0].raw), (9, r[9].raw)], "doc_id long, raw string")).orderBy("doc_id").collect()
    assert docs[0].title == "Uses PostgreSQL 16" and said in docs[0].body and docs[0]["keys"] == ["title", "date", "document_type", "claims"] and "y" * 4000 in docs[1].body


def test_statements_replace_those_of_their_key(spark, tmp_path):
    store = str(tmp_path / "s")
    ask = lambda *a: spark.createDataFrame([(i, c, s, k, None, None, DAY) for i, c, s, k in a], ASK)
    told = lambda df: [(r.request_id, r.outcome) for r in df.orderBy("request_id").collect()]
    assert told(statements.remember(store, 0, ask((1, "a", "one", "k"), (2, "a", "two", "k"), (3, "b", "one", "k"), (4, "a", "", "k")))) == [(1, "overtaken"), (2, "added"), (3, "added"), (4, "refused")]
    second = ask((5, "a", "two", "k"), (6, "b", "three", "k"), (7, "a", "free", None), (8, "a", "free", None))
    want = [(5, "unchanged"), (6, "changed"), (7, "overtaken"), (8, "added")]
    assert told(statements.remember(store, 1, second)) == want and told(statements.remember(store, 1, second)) == want
    assert rows(merges.read(spark, store, statements.STORED).select("corpus_id", "statement", "request_id")) == [("a", "free", 8), ("a", "two", 2), ("b", "three", 6)]
