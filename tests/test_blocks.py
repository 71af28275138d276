"""Block-wise search against a plain loop over all pairs: ties, odd vectors, rounding, several cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import blocks, relevance, retrieve


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())  # NaN equals NaN


def pairwise(q, i, k):
    """The search that it replaces: every pair is a row."""
    rank = F.row_number().over(relevance.Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return retrieve.scored_pairs(q, i).withColumn("rank", rank).where(F.col("rank") <= k)


@pytest.fixture
def tiny_cells(monkeypatch):
    for name, n in {"ITEMS": 40, "QUERIES": 7, "ROWS": 3}.items():
        monkeypatch.setattr(blocks, name, n)


def test_nearest_equals_all_pairs(spark, tiny_cells):
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)] + [[rng.choice((0.0, 0.5, 0.0009765625)) for _ in range(8)] for _ in range(90)]
    vectors += [None, [], [1.0] * 7, [1.0] * 7 + [None], [math.nan] * 8, [math.inf] + [0.5] * 7, [-math.inf] + [0.5] * 7, [1e18] * 8, [None] * 8] + [[0.25] * 8] * 30
    data = [(n * 5 % 1009, v) for n, v in enumerate(vectors)] + [(None, [0.5] * 8)]
    items = spark.createDataFrame(data, "item_id long, vector array<float>")
    asked = items.select(F.col("item_id").alias("query_id"), "vector").where("query_id % 3 <> 1 or query_id is null")
    for k in (1, 5, 400):
        assert rows(retrieve.top_k(asked, items, k).select("query_id", "item_id", "score", "rank")) == rows(pairwise(asked, items, k))
    assert rows(retrieve.top_k(asked, items.where("false"), 3)) == rows(retrieve.top_k(asked.where("false"), items, 3)) == []


def test_no_pair_leaves_its_block(spark):
    """What is shuffled and stored does not grow with the pairs: the plan has no join of queries and items."""
    items = spark.range(300).select(F.col("id").alias("item_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    plan = retrieve.top_k(items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), items, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan


def test_relevant_items_are_counted_by_label(spark):
    e = [(i, i % 4 if i % 7 else None) for i in range(60)] + [(100, 9)]
    items = spark.createDataFrame(e, "item_id long, label int")
    queries = items.where("item_id % 5 = 0").withColumnRenamed("item_id", "query_id")
    ranked = spark.createDataFrame([(q, i, n + 1) for q in range(0, 60, 5) for n, i in enumerate(x for x in range(q, q + 6) if x != q)] + [(100, 1, 1)], "query_id long, item_id long, rank int")
    every = queries.join(items, "label").where("query_id <> item_id").select("query_id", "item_id")
    pairs, total = retrieve.labelled(ranked, queries, items)
    assert rows(retrieve.retrieval_metrics(ranked, pairs, 5, total)) == rows(retrieve.retrieval_metrics(ranked, every, 5))


def test_nearest_sets_equal_all_pairs(spark, tiny_cells):
    rng = random.Random(8)
    words = ["alpha", "beta", "a", "b1", "gamma delta", "é", "Zeta", "x" * 40]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(120)] + ["", None, "...", " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(280))]
    items = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "item_id long, text string")
    asked = items.where("item_id % 2 = 0 or item_id > 350").withColumnRenamed("item_id", "query_id")
    sets = relevance.gram_sets(asked), relevance.gram_sets(items)
    for k in (1, 4, 300):
        want = relevance.best(relevance.trigram_scores(asked, items).where("query_id <> item_id"), "query_id", "item_id", k)
        assert rows(blocks.nearest(*sets, k, blocks.common_share, positive=True)) == rows(want)
    assert rows(blocks.nearest(sets[0], sets[1].where("false"), 2, blocks.common_share, positive=True)) == []


def test_shares_are_rounded_half_up(spark):
    """1 / 128 is 0.0078125."""
    texts = spark.createDataFrame([(0, "ab " + "c" * 3), (1, "ab"), (2, "abcdefghijklmnopqrstuvwxyz0123456789 ab")], "item_id long, text string")
    got = blocks.common_share(*(relevance.gram_sets(texts).toPandas()["feature"] for _ in range(2)))(0, 3)
    assert blocks.rounded(blocks.np.array([[1 / 128, 3 / 128]]), 0.0, lambda at: blocks.np.array([1 / 128, 3 / 128])[at]).tolist() == [[0.007813, 0.023438]]
    assert [got[i, i] for i in range(3)] == [1.0] * 3


def test_fusion_in_blocks_equals_fusion_of_stored_lists(spark, tiny_cells):
    rng = random.Random(9)
    ids = sorted(rng.sample(range(100_000), 230))
    vectors = [[rng.choice((0.0, 0.25, 0.5, rng.random())) for _ in range(3)] for _ in ids]
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "qq", "zzz"], k=rng.choice((0, 1, 2, 2, 3)))) for _ in ids]
    v, t = spark.createDataFrame(list(zip(ids, vectors)), "item_id long, vector array<float>"), spark.createDataFrame(list(zip(ids, texts)), "item_id long, text string")
    (vq, tq), items = (x.where(F.col("item_id").isin(ids[::17])).withColumnRenamed("item_id", "query_id") for x in (v, t)), v.select("item_id")
    want = relevance.fuse(retrieve.scored_pairs(vq, v), relevance.trigram_scores(tq, t).where("query_id <> item_id"), items, 2)
    got = relevance.fuse_blocks((vq.withColumnRenamed("vector", "feature"), v.withColumnRenamed("vector", "feature")), (relevance.gram_sets(tq), relevance.gram_sets(t)), items, 2)
    assert rows(got) == rows(want)


def test_places_equal_sorted_lists(spark, tiny_cells):
    """With NaN, infinite and null scores, and ties."""
    rng = random.Random(10)
    vectors = [[rng.choice((0.5, 1.0, 2.0)), rng.choice((0.0, 1.0))] for _ in range(70)] + [None, [1.0], [math.nan, 1.0], [math.inf, 0.0], [-math.inf, 1.0], [None, 1.0], [2e9, 1.0]]
    items = spark.createDataFrame([(i * 7 % 101, v) for i, v in enumerate(vectors)], "item_id long, vector array<float>")
    asked = items.where("item_id % 4 = 0").withColumnRenamed("item_id", "query_id")
    scores = retrieve.scored_pairs(asked, items)
    order = relevance.Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    want = scores.select("query_id", "item_id", (F.row_number().over(order) - 1).cast("long").alias("n"))
    both = [x.select(x.columns[0], retrieve.whole("vector").alias("feature")) for x in (asked, items)]
    found = blocks.scores_of(*both, scores.select("query_id", "item_id"), blocks.dots)
    assert rows(found) == rows(scores)
    assert rows(blocks.places(*both, found, blocks.dots).drop("held")) == rows(want)
