"""Threshold joins against all pairs, and streams that arrive in several batches."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import relevance, subjects
from palimpsest.streaming import activity, arrivals


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    skewed = lambda n: " ".join(rng.choice(words[: rng.randrange(1, 21)]) for _ in range(n))
    docs = [(i, skewed(rng.randrange(3, 12))) for i in range(80)] + [(100, None), (101, ""), (102, "the of and"), (103, "common " * 3000)]
    asked = [(i, skewed(rng.randrange(1, 7))) for i in range(25)] + [(50, None), (51, ""), (52, "unheard words here"), (53, docs[3][1]), (54, docs[3][1])]
    return spark.createDataFrame(asked, "question_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_equals_all_pairs(tables, least):
    q, d = tables
    every = relevance.overlap_scores(q, d)
    assert rows(relevance.overlap_above(q, relevance.term_index(d), least)) == rows(every.where(F.col("score") >= least))
    met = relevance.threshold_heads(q, relevance.term_index(d), least)[2]
    assert met.count() < every.count() or least < 0.5


def test_empty_tables(tables):
    q, d = tables
    assert rows(relevance.overlap_above(q.limit(0), relevance.term_index(d), 0.5)) == [] and rows(relevance.overlap_above(q, relevance.term_index(d.limit(0)), 0.5)) == []


def write(spark, folder, name, schema, *batches):
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")


def test_hints_in_batches_equal_one_batch(spark, tables):
    q, d = tables
    folder = activity.new_folder(spark)
    given = [(r.question_id, r.text) for r in q.collect()]
    stream = write(spark, folder, "asked", "statement_id long, text string", given[:10], given[10:11], given[11:])
    arrivals.store_index(relevance.term_index(d), folder)
    arrivals.hint_stream(stream, folder)
    want = subjects.duplicate_hints(q.withColumnRenamed("question_id", "statement_id"), d.select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim")))
    assert rows(arrivals.hints_so_far(spark, folder)) == rows(want)
    arrivals.hint_stream(stream, folder)  # nothing new: nothing changes
    assert rows(arrivals.hints_so_far(spark, folder)) == rows(want)


def test_sessions_run_over_batches(spark):
    folder = activity.new_folder(spark)
    at = lambda *hours: [(u, f"2024-01-01 {h:02}:{m:02}:00") for u, h, m in hours]
    raw = write(spark, folder, "events", "user_id long, t string", at((1, 1, 0), (2, 1, 0), (1, 1, 50)), at((1, 2, 50), (2, 3, 30)), at((3, 9, 0), (1, 2, 55)), at((3, 20, 0)))
    out = activity.drain(activity.sessions(raw.select("user_id", F.to_timestamp("t").alias("ts")), "user_id", "1 hour", "1 hour"), f"{folder}/s")
    got = sorted((r.user_id, r.first.hour, r.last.hour, r.last.minute, r.n) for r in out.collect())
    assert got == [(1, 1, 2, 55, 4), (2, 1, 1, 0, 1), (2, 3, 3, 30, 1), (3, 9, 9, 0, 1)]


def test_sliding_windows_hold_an_event_each(spark):
    folder = activity.new_folder(spark)
    raw = write(spark, folder, "events", "event_type string, t string", [("a", "2024-01-01 05:00:00"), ("a", "2024-01-01 07:00:00")], [("b", "2024-01-05 00:00:00")])
    out = activity.drain(activity.windowed_activity(raw.select("event_type", F.to_timestamp("t").alias("ts")), "12 hours", "1 hour", "6 hours"), f"{folder}/s")
    assert sorted((r.start.day, r.start.hour, r.n) for r in out.where("event_type = 'a'").collect()) == [(1, 0, 2), (1, 6, 1), (31, 18, 1)]


def test_texts_are_read_once(spark):
    """Of an index as of whole scores: what is asked of the texts is cut off before it is counted, met and scored."""
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(len(part))
            yield part

    q = spark.createDataFrame([(i, f"alpha beta{i} gamma delta{i}") for i in range(5)], "question_id long, text string")
    d = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma delta{i % 5} epsilon") for i in range(40)], "doc_id long, text string").repartition(2)
    docs = d.mapInPandas(counted, d.schema)
    index = relevance.term_index(docs)
    heads = relevance.threshold_heads(q, (index[0], d.agg(F.count("*").alias("n_docs"))), 0.6)
    assert relevance.overlap_above(q, index, 0.6, heads).count() > 0 and heads[2].count() > 0 and read.value == 40
    read.value = 0
    scores = relevance.overlap_scores(q, d)
    s = q.select("question_id", F.lit("beta1 betax").alias("subject"))
    assert subjects.subject_gates(s, docs, scores).count() == 5 and read.value <= 2 * 40  # once, and once to count the documents
