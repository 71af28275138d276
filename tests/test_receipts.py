"""Golden cases of receipts and of subject gates."""

from pyspark.sql import functions as F

from palimpsest.operators import receipts, subjects


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_each_check_of_a_receipt_fails_alone(spark):
    schema = "claim_id string, corpus_id string, key string, claim string, status string, version_id long, valid_from timestamp, valid_until timestamp, observed_at timestamp, val int"
    claims = spark.createDataFrame([("a", "c", "k", "red", "CURRENT", 1, None, None, None, 1)], schema)
    evidence = spark.createDataFrame([("a", "red", 4, 7)], "claim_id string, quote string, start_offset int, end_offset int")
    made = receipts.answer_receipts(claims.withColumn("observed_at", F.lit("2024-01-01").cast("timestamp")), evidence, "2024-01-05", "2024-01-05").select("receipt_id", "body")
    chunk = lambda text: spark.createDataFrame([(1, text)], "version_id long, chunk string")
    verdicts = lambda r, c, k: rows(receipts.verify_answers(r, c, k, "2024-01-05"), "integrity", "provenance", "temporal", "supersession")
    assert verdicts(made, claims, chunk("is: red")) == {(True, True, True, True)}
    assert verdicts(made.withColumn("body", F.concat("body", F.lit(" "))), claims, chunk("is: red")) == {(False, True, True, True)}
    assert verdicts(made, claims, chunk("is  red")) == {(True, True, True, True)} and verdicts(made, claims, chunk("it is red")) == {(True, False, True, True)}
    assert verdicts(made, claims.withColumn("valid_until", F.lit("2024-01-04").cast("timestamp")), chunk("is: red")) == {(True, True, False, True)}
    assert verdicts(made, claims.withColumn("status", F.lit("SUPERSEDED")), chunk("is: red")) == {(True, True, True, False)}
    assert verdicts(made, claims.limit(0), chunk("is: red")) == {(True, True, None, None)}


def test_decisions_replay_as_same_changed_gone_or_damaged(spark):
    c = spark.createDataFrame([(1, "a", 0.9, 0.0), (2, "a", 0.9, 0.0), (2, "b", 0.5, 0.0), (3, "a", 0.9, 0.0), (4, "a", 0.9, 0.0)], "question_id long, item_id string, relevance double, overlap double")
    given = receipts.decision_receipts(c, 0.3).withColumn("body", F.when(F.col("question_id") == 4, "{}").otherwise(F.col("body")))
    now = c.where("question_id <> 3 and not (question_id = 2 and item_id = 'a')")
    assert rows(receipts.replay_decisions(given, now, 0.3), "question_id", "outcome") == {(1, "same"), (2, "changed"), (3, "gone"), (4, "damaged")}


def test_subject_gates(spark):
    docs = spark.createDataFrame([(i, "default backend postgres") for i in range(300)] + [(300, "kafka topic")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "kubernetes"), (2, "default kubernetes"), (3, "default postgre"), (4, "postgres kubernetes"), (5, "kafka"), (6, "kubernetes"), (7, ""), (8, None)], "question_id long, subject string")
    scores = spark.createDataFrame([(1, 5, 0.4), (2, 5, 0.4), (3, 5, 0.4), (4, 5, 0.4), (5, 5, 0.9), (5, 300, 0.3), (6, 5, 0.7)], "question_id long, doc_id long, score double")
    assert rows(subjects.subject_gates(asked, docs, scores), "question_id", "gate") == {
        (1, "subject_absent"), (2, "distinctive_absent"), (3, None), (4, None), (5, "subject_not_the_answer"), (6, None), (7, None), (8, None),
    }


def test_sections_add_context_but_no_statistics(spark):
    docs = spark.createDataFrame([(1, "red", "store"), (2, "blue", "store"), (3, "store green", "")], "doc_id long, text string, heading string")
    q = spark.createDataFrame([(1, "store red")], "question_id long, text string")
    got = {r.doc_id: r.score for r in subjects.contextual_scores(q, docs).collect()}
    assert got[1] == 1.0 and got[2] == got[3] == 0.5  # both words are in the text of one document
