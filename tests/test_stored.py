"""The stored archive's promises: marks make batches visible, reruns change nothing; lenient logs; rules of sets; late events."""

from palimpsest.operators import logs, stored
from palimpsest.streaming import arrivals


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_unmarked_batches_are_invisible_and_reruns_overwrite(spark, tmp_path):
    root, part = str(tmp_path), lambda *ids: {"versions": spark.createDataFrame([(i, "c") for i in ids], "id long, corpus_id string")}
    stored.append(root, 0, part(1, 2))
    stored.append(root, 1, part(3), commit=False)
    assert rows(stored.load(spark, root, "versions"), "id") == [(1,), (2,)]
    stored.append(root, 0, part(1, 2))
    stored.append(root, 1, part(3, 4))
    assert rows(stored.load(spark, root, "versions"), "id", "batch") == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_rehydrate_removes_deleted_and_blank_and_keeps_live_only(spark):
    latest = spark.createDataFrame([("c", "a", "NEW", "new a"), ("c", "b", "DELETED", None), ("c", "e", "NEW", " ")], "corpus_id string, path string, event string, content string")
    live = spark.createDataFrame([("c", "a", "old a"), ("c", "b", "old b"), ("c", "z", "own"), ("d", "a", "other corpus")], "corpus_id string, path string, content string")
    got = rows(stored.rehydrate(latest, live), "corpus_id", "path", "content", "origin")
    assert got == [("c", "a", "new a", "rebuilt"), ("c", "b", None, "removed"), ("c", "e", None, "removed"), ("c", "z", "own", "live_only"), ("d", "a", "other corpus", "live_only")]
    assert stored.rehydrate(latest.limit(0), live).count() == 4 and stored.rehydrate(latest, live.limit(0)).count() == 3


def test_stages_hold_until_the_next_move(spark):
    p = spark.createDataFrame([("a", 0, "1"), ("b", 1, "2"), ("a", 2, "3")], "path string, stage int, content string")
    gone = spark.createDataFrame([("b", 2), ("c", 3)], "path string, stage int")
    assert rows(stored.stages(p, gone), "stage", "path", "content") == [(0, "a", "1"), (1, "a", "1"), (1, "b", "2"), (2, "a", "3"), (3, "a", "3")]
    assert stored.stages(p.limit(0), gone.limit(0)).count() == 0


def test_corrupt_log_lines_are_skipped(spark):
    lines = spark.createDataFrame([('{"id": 1, "s": "x"}',), ('{"id": 2, "s": "y',), ("",), (None,), ("[]",), ('{"id": "no"}',)], "value string")
    assert rows(logs.read_log(lines, "id long, s string"), "id", "s") == [(1, "x")]
    assert rows(logs.read_log(logs.log_lines(spark.createDataFrame([(1, None)], "id long, s string"), "id", "s"), "id long, s string"), "id", "s") == [(1, None)]


def test_question_rules(spark):
    q = spark.createDataFrame([(1, "a", ["d"], None), (2, "a", ["d"], None), (3, None, ["d"], None), (4, "b", None, True), (5, "c", ["d"], True), (6, "e", [], False)], "question_id long, query string, expected array<string>, expect_empty boolean")
    assert rows(logs.check_questions(q), "question_id", "reason") == [(1, None), (2, "duplicate_query"), (3, "query_missing"), (4, None), (5, "expected_with_expect_empty"), (6, "expected_missing")]


def test_authored_claims_take_a_quote_or_a_list(spark):
    claim = '{"key": "%s", "value": "v", "claim": "the  store is red", "evidence": %s}'
    docs = [(1, "[" + claim % ("a", '"the store"') + "," + claim % ("b", '["the store", "red"]') + "]"), (2, "[" + claim % ("a", '"[draft] store"') + "]"), (3, "[]"), (4, None), (5, "[" + claim % ("a", '"[gone]"') + "]")]
    df = spark.createDataFrame([(i, c, ["we say: the store\tis red", "[draft] store: the store is red"]) for i, c in docs], "doc_id long, claims string, chunks array<string>")
    assert rows(logs.check_authored(df), "doc_id", "n_claims", "reason") == [(1, 2, None), (2, 1, None), (3, 0, None), (4, 0, None), (5, 1, "evidence_not_in_chunk")]


def test_late_events_are_set_aside_once(spark, tmp_path):
    folder = str(tmp_path)
    for i, times in enumerate((["2024-01-10", "2024-01-01"], ["2024-01-09", "2024-01-07", "2024-01-20"], ["2024-01-15"])):
        spark.createDataFrame([(t,) for t in times], "ts string").selectExpr("cast(ts as timestamp) ts").write.parquet(f"{folder}/in/arrival={i}")
        feed = spark.readStream.schema("ts timestamp").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        arrivals.split_late(feed, folder, "2 days")
    late = spark.read.option("basePath", f"{folder}/late").parquet(f"{folder}/late").selectExpr("cast(to_date(ts) as string) d", "batch")
    assert rows(late, "d", "batch") == [("2024-01-07", 1), ("2024-01-15", 2)]
