"""The best related documents by classes of tags against all pairs."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import relevance


def test_related_by_classes_equals_all_pairs(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(f"c{i % 2}", i, rng.choice((None, [], rng.choices(["a", "b", "c", "d", None], k=3)))) for i in range(150)], "corpus_id string, id long, tags array<string>")
    asked = F.col("id") % 5 == 0
    for k in (1, 3, 200):
        want = relevance.best(relevance.related(docs, asked), "query_id", "id", k)
        assert sorted(map(tuple, relevance.related_best(docs, asked, k).collect())) == sorted(map(tuple, want.collect()))
