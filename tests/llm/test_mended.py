"""Faults found by review, each with its case."""

import collections

from palimpsest.llm import embeddings, html, mixing


def test_boxes_inside_an_article_go():
    sentence = "This sentence has more than eighty characters in it, so that it looks like a real paragraph of text. "
    article = "".join(f"<p>{sentence * 3}{i}</p>" for i in range(6))
    for name in ("alert", "alert-warning", "widget", "related-posts", "recommended", "share", "cta", "signup", "gdpr"):
        text = html.main_text(f"<body><article><h1>Title</h1>{article}<div class='{name}'><p>BOX {sentence}</p></div>{article}</article></body>")
        assert "BOX" not in text and text.count("This sentence") == 36 and text.startswith("Title")
    mostly = html.main_text(f"<body><div class='widget'>{article}</div><p>{sentence}</p></body>")
    assert mostly.count("This sentence") >= 18  # what holds most of the page stays, whatever its name


def test_quotes_that_never_close():
    assert html.main_text("<p>Hi<a href='x>y") == "Hi" and html.main_text('<p>Hi<a href="x>y</a></p>') == "Hi"
    assert html.main_text("<p a=b'c d=\"e>f\">Hi") == "Hi" and html.main_text("<p a = >Hi</p>") == "Hi"
    assert html.main_text("<a x='" * 20000) == ""


def test_repeated_ids_of_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])]
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == collections.Counter([(1, 3, 1), (1, 1, 1), (2, 3, 1), (3, 1, 1), (4, 0, 4), (None, 0, None), (5, 3, 1), (5, 3, 1)])


def test_mixed_rows_keep_their_other_columns(spark):
    rows = [(1, "a b c", "s", x) for x in ("en", "de", "fr")] + [(2, "a b c", "s", None)] * 3
    got = collections.Counter(tuple(r) for r in mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect())
    assert set(got) == set(rows) and all(got[r] <= 2 for r in rows[:3])  # a source alone is taken up to its share of 150 %
