"""Faults found by review, each with its case."""

from pyspark.sql import functions as F

from palimpsest.operators import select, state, texts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_instants_do_not_follow_the_session_zone(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00",), ("soon",), (None,)], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r[0] for r in df.select(F.unix_seconds(texts.instant(F.col("t")))).collect()] == [1704067200, 1704067200, None, None, None]
        assert df.select(*[F.unix_seconds(state.instant(x)) for x in ("2024-01-01", "2024-01-01 00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00")]).first()[:] == (1704067200,) * 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_near_ties_look_at_their_own_corpus(spark):
    c = spark.createDataFrame([(1, "a", "k1", "x", None), (2, "a", "k2", None, None), (3, "b", "k1", None, None), (4, "b", "k2", None, "y")], "claim_id long, corpus_id string, key string, valid_from string, valid_until string")
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.85), (2, 3, 0.85), (2, 4, 0.9)], "request_id long, claim_id long, score double")
    got = rows(select.near_tie_order(select.best_keys(pairs, c, 0.5), c))
    assert got == [(1, "k1", 2), (1, "k2", 1), (2, "k1", 1), (2, "k2", 2)]


def test_prefixes_of_the_lengths_asked(spark):
    c = spark.createDataFrame([("abcd", "x", "k", "p"), ("abce", "x", "k", "q"), ("ab", "y", "k", "r")], "claim_id string, corpus_id string, key string, path string")
    refs = spark.createDataFrame([(1, "x", "prefix", "abc"), (2, "x", "prefix", "abcd"), (3, "x", "prefix", "abcdef"), (4, "y", "prefix", "abc"), (5, "y", "prefix", "a"), (6, "x", "key", "k")], "ref_id long, corpus_id string, kind string, ref string")
    assert [r[3:] for r in rows(select.resolve_references(refs, c))] == [("ambiguous", None), ("resolved", "abcd"), ("unresolved", None), ("unresolved", None), ("resolved", "ab"), ("ambiguous", None)]


def test_seals_cover_content(spark):
    v = spark.createDataFrame([(i, "c", "NEW", f"f{i}", i) for i in range(50)], "version_id long, corpus_id string, event string, fp string, observed_at int")
    whole, same, other = select.seal(v, F.lit(99)), select.seal(v.repartition(7), F.lit(99)), select.seal(v.withColumn("fp", F.when(F.col("version_id") == 3, "g").otherwise(F.col("fp"))), F.lit(99))
    assert rows(select.broken_seals(whole, same)) == [] and rows(select.broken_seals(whole, other)) == [("c", 50, 50)]


def test_subjects_and_contrasts(spark):
    asked = ["At first, before noon, who owns it", "viewed as a whole; rather than that, which cache is used", "who owned it during the launch", "alpha limit and beta limit, as opposed to gamma", "after 2024-01-01", "", None]
    df = spark.createDataFrame([(a,) for a in asked], "q string")
    got = df.select(texts.subject(F.col("q"), ("launch",)).alias("s"), texts.topics(F.col("q"), lambda x: F.split(x, " ")).alias("t")).collect()
    assert [r.s for r in got] == ["who owns it", "which cache is used", "who owned it", asked[3], "after", "", None]
    assert got[3].t == ["alpha limit and beta limit", "alpha limit", "beta limit"]
