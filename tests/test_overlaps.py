"""Requests and items by shared terms against all pairs, with common terms that are never met pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import matching, overlaps, select

FLOOR = 0.3


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(5)
    common, rare = ["user", "click", "view"], [f"w{i}" for i in range(30)]
    draw = lambda n: sorted(set(r.sample(common, r.randint(0, 3)) + r.sample(rare, n)))
    asked = [(i, f"c{i % 2}", draw(r.randint(0, 3)) or ["user"]) for i in range(40)]
    items = [(f"{i}:x", f"c{i % 2}", draw(r.randint(0, 2)), i % 7, r.randint(0, 9) * 10_000_000) for i in range(300)]
    x = overlaps.overlaps(spark.createDataFrame(asked, "request_id long, corpus_id string, terms array<string>"), spark.createDataFrame(items, "item_id string, corpus_id string, said array<string>, grp long, at long"), "said", 60)
    rows = spark.createDataFrame([(i[0], i[3], i[4]) for i in items], "item_id string, grp long, at long")
    pairs = [(q, i, len(set(t) & set(s)) / len(t), g, at) for q, c, t in asked for i, d, s, g, at in items if c == d and len(set(t) & set(s)) / len(t) >= FLOOR]
    return x, rows, pairs


def of(pairs, q):
    return [p for p in pairs if p[0] == q]


def test_common_terms_make_no_pairs(case):
    x, _, pairs = case
    assert 0 < x.near.count() < len(pairs) and x.kinds.count() < 100


def test_counts(case):
    x, _, pairs = case
    want = {q: (len(of(pairs, q)), max(p[2] for p in of(pairs, q))) for q in {p[0] for p in pairs}}
    assert {r.request_id: (r.n, r.best) for r in overlaps.counts(x, FLOOR).collect()} == want


def test_best_and_groups(case):
    x, rows, pairs = case
    top = {p[0]: max(y[2] for y in of(pairs, p[0])) for p in pairs}
    kept = F.col("top") - F.col("score") <= 0.1
    assert {tuple(r) for r in overlaps.best(x, FLOOR, kept).collect()} == {p[:3] for p in pairs if top[p[0]] - p[2] <= 0.1}
    groups = overlaps.best(x, FLOOR, kept, rows.select("item_id", F.col("grp").alias("group")))
    assert {(r.request_id, r.group) for r in groups.collect()} == {(p[0], p[3]) for p in pairs if top[p[0]] - p[2] <= 0.1}


@pytest.mark.parametrize("group", [None, "grp"])
def test_first_hold_the_first(case, group):
    x, rows, pairs = case
    got = {tuple(r) for r in overlaps.first(x, FLOOR, rows, ["at", "item_id"], 3, group).collect()}
    assert got <= {p[:3] for p in pairs} and len(got) < len(pairs)
    for q in {p[0] for p in pairs}:
        once = {}
        for p in sorted(of(pairs, q), key=lambda p: (-p[2], p[4], p[1])):
            once.setdefault(p[3] if group else p[1], p)
        assert {p[:3] for p in list(once.values())[:3]} <= got


@pytest.mark.parametrize("by_score", [True, False])
def test_places(spark, case, by_score):
    x, rows, pairs = case
    order = (lambda p: (-p[2], p[1])) if by_score else (lambda p: (p[4], p[1]))
    want = {(q, p[1]): n for q in {p[0] for p in pairs} for n, p in enumerate(sorted(of(pairs, q), key=order), 1) if n % 3 == 0}
    asked = spark.createDataFrame(list(want), "request_id long, item_id string")
    assert {(r.request_id, r.item_id): r["rank"] for r in overlaps.places(x, FLOOR, asked, rows, by_score).collect()} == want


def test_candidates_of_the_rarest_term_and_of_a_share_each(spark):
    asked = spark.createDataFrame([(1, "c", ["user", "n1"], 1.0), (2, "c", ["user", "n9"], 0.3), (3, "c", ["n1", "n2", "user"], 0.65)], "request_id long, corpus_id string, terms array<string>, least double")
    items = spark.createDataFrame([(i, "c", ["user", f"n{i}"]) for i in range(5)], "item_id long, corpus_id string, said array<string>")
    pairs = lambda share: {tuple(r) for r in matching.candidates(asked, items, "said", share).collect()}
    assert pairs(None) == {(1, 1), (3, 1)} | {(2, i) for i in range(5)}
    assert pairs(F.col("least")) == {(1, 1), (3, 1), (3, 2)} | {(2, i) for i in range(5)}


def shuffled(df):
    """Rows of the result, and how many rows its last plan shuffled."""
    out, n, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if "QueryStage" in name else []
        made, children = p.metrics().get("shuffleRecordsWritten"), p.children()
        n += made.get().value() if made.isDefined() else 0
        todo += [children.apply(i) for i in range(children.size())]
    return sorted(map(tuple, out)), n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lists_in_segments_equal_lists_of_rows(spark, monkeypatch, seed):
    """Blocks of three keys, so that segments begin, end and change inside and between them."""
    monkeypatch.setattr(select, "BLOCK", 3)
    r = random.Random(seed)
    common, rare = ["user", "click", "view", "of"], [f"w{i}" for i in range(12)]
    asked = [(i, f"c{i % 2}", sorted(set(r.sample(common, r.randint(0, 3)) + r.sample(rare, r.randint(0, 4)))) or ["user"]) for i in range(50)]
    claims = [(f"{i}", f"c{i % 2}", f"k{r.randrange(25):02}", sorted(set(r.sample(common, r.randint(0, 3)) + r.sample(rare, r.randint(0, 2)))), r.choice([None, "x", "x", "x"]), r.choice([None, None, "y"])) for i in range(300)]
    x = overlaps.overlaps(spark.createDataFrame(asked, "request_id long, corpus_id string, terms array<string>"), spark.createDataFrame([(c[0], c[1], c[3]) for c in claims], "item_id string, corpus_id string, said array<string>"), "said", 40)
    c = spark.createDataFrame([(*c[:3], *c[4:]) for c in claims], "claim_id string, corpus_id string, key string, valid_from string, valid_until string")
    want = select.near_tie_order(select.overlap_keys(x, c, FLOOR, 0.5), c)
    got = select.overlap_tie_order(x, c, FLOOR, 0.5)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and x.near.count() > 100


def test_listed_rows_are_not_shuffled(spark):
    n = 300
    asked = spark.range(n).select(F.col("id").alias("request_id"), F.lit("c").alias("corpus_id"), F.array(F.lit("click"), F.lit("user"), F.format_string("n%d", "id")).alias("terms"))
    c = spark.range(n).select(F.format_string("i%03d", "id").alias("claim_id"), F.lit("c").alias("corpus_id"), F.format_string("k%03d", "id").alias("key"), F.array(F.lit("click"), F.lit("user"), F.format_string("n%d", "id")).alias("said"), F.when(F.col("id") % 2 == 0, "x").alias("valid_from"), F.lit(None).cast("string").alias("valid_until"))
    x = overlaps.overlaps(asked, c.select("corpus_id", F.col("claim_id").alias("item_id"), "said"), "said", 60)
    rows, moved = shuffled(select.overlap_tie_order(x, c, FLOOR, 0.5))
    before, moved_before = shuffled(select.near_tie_order(select.overlap_keys(x, c, FLOOR, 0.5), c))
    assert rows == before and len(rows) == n * n and moved < 10 * n < n * n < moved_before
