"""Values at places of sorted groups, passages in texts, selectors of many requests."""

import random
from statistics import median

from pyspark.sql import functions as F

from palimpsest.operators import matching, relevance, retrieve
from palimpsest.operators.maintain import sample_stats


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_values_at_places(spark):
    rng = random.Random(3)
    groups = {"skewed": [10.0 ** rng.randint(-9, 9) * rng.random() for _ in range(3001)], "ties": [rng.choice((1.0, 2.0)) for _ in range(500)], "one": [5.0], "two": [1.0, 4.0], None: [2.0, 1.0, 7.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in [*xs, None]], "g string, x double")
    at = retrieve.values_at(df, "g", "x", lambda n: F.array(F.lit(0), F.floor(n / 3), n - 1))
    want = {(g, len(xs), p, sorted(xs)[p]) for g, xs in groups.items() for p in {0, len(xs) // 3, len(xs) - 1}}
    assert set(map(tuple, at.collect())) == want and at.count() == len(want)
    got = {r.g: (r.n, r.median) for r in sample_stats(df, "g", "x").collect()}
    assert got == {g: (len(xs) + 1, round(median(xs), 4)) for g, xs in groups.items()}
    assert rows(retrieve.medians(df.where("false"), "g", "x")) == []


def test_passages_in_texts(spark):
    rng = random.Random(5)
    words = ["a", "ab", "abc", "b", "the", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)] + ["", None, "a\tab\nabc b", " a  b"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (1, "another text of the same id")]
    asks = ["", "a", "b a", "c", "bc a", "a ab", "c b t", "he the th", "the the the the", "\tab\na", None, "zzz", "é a é", "a", "same id"] + [t[1:9] for t in texts[:20] if t]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(asks)), "item_id long, passage string")
    want = sorted([(i, k) for i, t in docs for k, a in enumerate(asks) if t is not None and a is not None and a in t], key=repr)
    got = rows(retrieve.containing(d, p))
    assert set(got) == set(want)
    assert rows(retrieve.containing(d.where("false"), p)) == [] and rows(retrieve.containing(d, p.where("false"))) == []
    assert sorted(got, key=repr) == want


def test_selectors_of_many_requests(spark):
    docs = [(i, f"c{i % 3}" if i % 7 else None, f"t{i % 2}", i % 5 or None) for i in range(40)]
    asked = [(i, (None, "c0", "c1", "c9")[i % 4], (None, "t0", "t1")[i % 3], (None, 2)[i % 2], (None, 3, 4)[i // 7 % 3]) for i in range(1500)]
    d, r = spark.createDataFrame(docs, "id long, corpus_id string, document_type string, date int"), spark.createDataFrame(asked, "request_id long, corpus_id string, document_type string, since int, until int")
    want = sorted((q, i) for q, c, t, a, b in asked for i, dc, dt, day in docs if c in (None, dc) and t in (None, dt) and (a is None or (day is not None and day >= a)) and (b is None or (day is not None and day <= b)))
    assert sorted(map(tuple, matching.any_selectors(r, d).collect())) == want


def test_fusion_is_of_whole_lists(spark):
    rng = random.Random(11)
    ids = sorted(rng.sample(range(400_000), 400))
    asked = ids[::90]
    vector = {(q, i): round(rng.choice((0.1, 0.2, rng.random())), 6) for q in asked for i in ids if i != q}
    for share in (0.02, 0.6):  # a list shorter than what is looked at, and a long one
        keyword = {p: round(1 - vector[p] if rng.random() < 0.5 else rng.random() / 2 + 0.01, 6) for p in vector if p[0] != asked[0] and rng.random() < share}
        keyword = {p: w for p, w in keyword.items() if w > 0}
        want = []
        for q in asked:
            mine = [i for i in ids if i != q]
            rv = {i: n for n, i in enumerate(sorted(mine, key=lambda i: (-vector[q, i], i)), 1)}
            rk = {i: n for n, i in enumerate(sorted(mine, key=lambda i: (-keyword.get((q, i), 0.0), i)), 1)}
            score = {i: round(1 / (60 + rv[i]) + 1 / (60 + rk[i]), 9) for i in mine}
            want += [(q, i, score[i], n) for n, i in enumerate(sorted(mine, key=lambda i: (-score[i], i))[:4], 1)]
        v, w = (spark.createDataFrame([(*p, s) for p, s in x.items()], "query_id long, item_id long, score double") for x in (vector, keyword))
        got = relevance.fuse(v, w, spark.createDataFrame([(i,) for i in ids], "item_id long"), 4).select("query_id", "item_id", "score", "rank")
        assert rows(got) == sorted(want, key=repr)
