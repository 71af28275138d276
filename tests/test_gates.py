"""Golden cases of the gates that generated tables reach seldom or never."""

from palimpsest.operators import gates


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_targets_pair_by_key_then_by_a_subject_of_one_key(spark):
    authored = spark.createDataFrame([(1, "a", "Store: Postgres 16"), (1, "b", "Cache: none"), (2, "x", "one two three four five six"), (2, "y", "one two three four five seven"), (3, "k", "Owner: Ann")], "group_id long, key string, claim string")
    targets = spark.createDataFrame([(1, "t1", "a", "Store: Postgres 15"), (1, "t2", "old", "cache : redis"), (2, "t3", "z", "one two three four five eight"), (3, "t4", "q", "Owner: Bob"), (3, "t5", "r", "Owner: Cy"), (4, "t6", "s", "")], "group_id long, target_id string, key string, claim string")
    assert rows(gates.pair_targets(authored, targets), "target_id", "key", "outcome") == {
        ("t1", "a", "key"), ("t2", "b", "subject"), ("t3", None, "refused"), ("t4", "k", "subject"), ("t5", None, "unpaired"), ("t6", None, "unpaired"),
    }


def test_explicit_targets_refuse_what_is_not_one_claim(spark):
    active = spark.createDataFrame([("c1", "c", 1, "db"), ("c2", "c", 2, "db"), ("c3", "c", 3, "os"), ("c4", "c", 9, "os"), ("c5", "other", 5, "os")], "claim_id string, corpus_id string, doc_id long, key string")
    asked = [(1, "c3", None), (2, "c3", None), (3, "c4", None), (4, None, "db"), (5, None, "os"), (6, None, "new"), (7, None, "gone"), (8, None, None), (9, "c5", None), (10, "c1", None)]
    requests = spark.createDataFrame([(i, "c", 9, s, t) for i, s, t in asked], "request_id long, corpus_id string, doc_id long, supersedes string, topic_key string")
    written = [(1, "os"), (1, "db"), (2, "os2"), (2, "os3"), (4, "db"), (5, "os"), (6, "new"), (7, "x"), (10, "only")]
    authored = spark.createDataFrame(written, "request_id long, key string")
    assert rows(gates.explicit_targets(requests, authored, active), "request_id", "outcome", "target_id", "key") == {
        (1, "explicit_claim_id", "c3", "os"), (2, "ambiguous_authored", None, None), (3, "target_not_active", None, None), (4, "topic_ambiguous", None, None), (5, "topic_key", "c3", "os"),
        (6, "no_target", None, None), (7, "topic_key_not_authored", None, None), (8, "none", None, None), (9, "target_not_active", None, None), (10, "explicit_claim_id", "c1", "only"),
    }


def test_a_conflict_left_with_one_side_is_promoted(spark):
    c = spark.createDataFrame([("a", "c", "k", "CONFLICTING", None), ("b", "c", "k", "CONFLICTING", "rejected"), ("d", "c", "m", "CURRENT", "draft")], "claim_id string, corpus_id string, key string, status string, info_state string")
    assert rows(gates.withhold(c), "claim_id", "outcome") == {("a", "promoted"), ("b", "withheld"), ("d", "withheld")}
    sides = c.where("status = 'CONFLICTING'").selectExpr("claim_id", "corpus_id", "key", "concat('p/', claim_id) path")
    asked = spark.createDataFrame([(1, "p"), (2, "p/a")], "request_id long, prefix string")
    from pyspark.sql import functions as F

    assert rows(gates.scope_conflicts(asked, sides, F.col("path").startswith(F.col("prefix"))), "request_id", "claim_id", "outcome") == {(1, "a", "kept"), (1, "b", "kept"), (2, "a", "promoted")}


def test_decisions_abstain_on_weak_scores_and_break_ties(spark):
    c = spark.createDataFrame([(1, "a", 0.9, 0.1), (1, "b", 0.9, 0.2), (2, "a", 0.29, 1.0), (3, "a", 0.4, 0.0), (3, "b", 0.38, 0.0)], "question_id long, item_id string, relevance double, overlap double")
    assert rows(gates.decide(c), "question_id", "selected_id", "confidence", "abstained") == {(1, "b", 0.63, False), (2, None, 0.29, True), (3, "a", 0.286, True)}


def test_packs_are_equal_by_the_order_of_their_times(spark):
    pack = lambda *r: spark.createDataFrame(list(r), "pack_id long, item_id long, body string, at long")
    left = pack((1, 1, "x", 10), (1, 2, "y", 20), (2, 1, "x", 10), (3, 1, "x", 1))
    right = pack((1, 1, "x", 5), (1, 2, "y", 900), (2, 1, "z", 10), (3, 1, "x", 1), (3, 2, "y", 2))
    assert rows(gates.equal_packs(left, right), "pack_id", "equal") == {(1, True), (2, False), (3, False)}
