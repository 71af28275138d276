"""Merges into stored tables: outcomes, reruns, failures between data and manifest; claim state from a feed that is cut off."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import merges, state
from palimpsest.plans import registry
from palimpsest.sources import archive
from palimpsest.streaming import activity, claim_state

from .conftest import SF

SCHEMA = "k string, id long, hash string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def changes(spark, *given):
    return spark.createDataFrame(given, SCHEMA + ", deleted boolean, at int")


def put(spark, root, batch, *given, **how):
    merges.merge(root, batch, changes(spark, *given).drop("at"), ["k"], SCHEMA, buckets=4, **how)


def test_merge_outcomes_and_time_travel(spark):
    root = activity.new_folder(spark)
    assert rows(merges.read(spark, root, SCHEMA)) == [] and merges.batches(spark, root) == []
    put(spark, root, 0, ("a", 1, "x", False, 0), ("b", 2, None, False, 0), ("c", 3, "z", False, 0), (None, 9, "n", False, 0))
    how = {"same": ["hash"], "keep": ["id"]}
    given = (("a", 7, "x", False, 0), ("b", 8, None, False, 0), ("c", 9, "new", False, 0), ("d", 4, "d", False, 0), ("e", 5, "e", True, 0))
    put(spark, root, 3, *given, **how)
    want = [("a", 1, "x"), ("b", 2, None), ("c", 3, "new"), ("d", 4, "d")]
    assert rows(merges.read(spark, root, SCHEMA)) == want
    assert dict(rows(merges.outcomes(spark, root, 3))) == {"unchanged": 2, "changed": 1, "added": 1, "absent": 1}
    put(spark, root, 3, ("zz", 1, "zz", False, 0))  # that batch is there already
    assert rows(merges.read(spark, root, SCHEMA)) == want
    put(spark, root, 4, *[(k, None, None, True, 0) for k in "abcd"])
    assert rows(merges.read(spark, root, SCHEMA)) == [] and rows(merges.read(spark, root, SCHEMA, 3)) == want and len(rows(merges.read(spark, root, SCHEMA, 1))) == 3


def test_last_change_of_a_batch_counts(spark):
    root = activity.new_folder(spark)
    given = changes(spark, ("a", 1, "first", False, 1), ("a", 2, "last", False, 5), ("a", 3, "mid", True, 3), ("b", 1, "x", False, 1), ("b", 1, "x", True, 2))
    merges.merge(root, 0, given, ["k"], SCHEMA + ", at int", order="at")
    assert rows(merges.read(spark, root, SCHEMA + ", at int")) == [("a", 2, "last", 5)]


def test_a_batch_that_dies_before_its_manifest_leaves_the_table(spark, monkeypatch):
    root = activity.new_folder(spark)
    put(spark, root, 0, ("a", 1, "x", False, 0), ("b", 2, "y", False, 0))
    with monkeypatch.context() as m:
        m.setattr(merges, "_places", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")) if len(merges.batches(spark, root)) == 1 and merges._children(spark, f"{root}/data/batch=1") else {0: 0})
        with pytest.raises(RuntimeError):
            put(spark, root, 1, ("a", 5, "new", False, 0), ("b", 2, "y", True, 0))
            put(spark, root, 1, ("a", 5, "new", False, 0))
    assert merges._children(spark, f"{root}/data/batch=1") and rows(merges.read(spark, root, SCHEMA)) == [("a", 1, "x"), ("b", 2, "y")]
    for _ in range(2):
        put(spark, root, 1, ("a", 5, "new", False, 0), ("b", 2, "y", True, 0))
    assert rows(merges.read(spark, root, SCHEMA)) == [("a", 5, "new")]


def test_replaced_groups(spark):
    root = activity.new_folder(spark)
    first = spark.createDataFrame([("a", i, "x") for i in range(3)] + [("b", 1, "y"), ("b", 1, "y")], SCHEMA)
    merges.replace(root, 0, first, first, ["k"], SCHEMA, 4)
    merges.replace(root, 1, spark.createDataFrame([("a", 9, "n"), ("c", 1, "left out")], SCHEMA), spark.createDataFrame([("a",), ("a",), ("gone",), (None,)], "k string"), ["k"], SCHEMA, 4)
    assert rows(merges.read(spark, root, SCHEMA)) == [("a", 9, "n"), ("b", 1, "y"), ("b", 1, "y")]


def test_backfill_encodes_each_text_once(spark):
    root, seen = activity.new_folder(spark), spark.sparkContext.accumulator(0)

    def encode(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    claims = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None), (5, "")], "claim_id long, text string")
    for batch, part in ((0, claims.where("claim_id < 3")), (1, claims), (1, claims), (2, claims)):
        merges.backfill(root, batch, part, merges.embed_with(encode), "m")
    assert seen.value == 3 and sorted(r.vector[0] for r in merges.read(spark, root, merges.VECTORS).collect()) == [0.0, 1.0, 2.0]


def feed(spark, folder, parts):
    schema = "corpus_id string, doc_id long, version_number int, event string, claims array<struct<key:string,claim_id:string,val:long>>"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_claims_are_set_and_retired(spark):
    folder = activity.new_folder(spark)
    stream = feed(spark, folder, [[("c", 1, 1, "NEW", [("k", "1k", 5), ("m", "1m", 6)]), ("c", 2, 1, "NEW", [("k", "2k", 1)])], [("c", 1, 2, "MODIFIED", [("k", "1k2", 7)]), ("c", 2, 2, "DELETED", [])], [("c", 1, 1, "NEW", [("old", "late", 0)]), ("c", 2, 3, "RESTORED", [("n", "2n", None and 0 or 3)])]])
    claim_state.keep_live_claims(stream, folder, f"{folder}/table")
    assert rows(claim_state.live_claims(spark, f"{folder}/table")) == [("c", 1, "k", "1k2", 7, 2), ("c", 2, "n", "2n", 3, 3)]
    assert len(merges.batches(spark, f"{folder}/table")) == 3
    assert rows(merges.read(spark, f"{folder}/table", claim_state.STORED, 0)) == [("c", 1, "k", "1k", 5, 1), ("c", 1, "m", "1m", 6, 1), ("c", 2, "k", "2k", 1, 1)]


def test_a_killed_batch_is_applied_once_and_equals_current_claims(spark, monkeypatch):
    folder = activity.new_folder(spark)
    v = archive.versions(spark, SF)
    c = archive.claims(v)
    nested = claim_state.nested_versions(v, c)
    for part in range(2):
        nested.where(F.col("version_number") % 2 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(nested.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    whole = merges.merge

    def dies(root, batch, *args, **how):
        whole(root, batch, *args, **how)
        if batch == 1:
            raise RuntimeError("after the manifest, before the stream's own commit")

    with monkeypatch.context() as m:
        m.setattr(merges, "merge", dies)
        with pytest.raises(Exception, match="StreamingQueryException|after the manifest"):
            claim_state.keep_live_claims(stream, folder, f"{folder}/table")
    claim_state.keep_live_claims(stream, folder, f"{folder}/table")
    live = claim_state.live_claims(spark, f"{folder}/table").select("claim_id")
    now = state.resolve(v, c, "2030-01-01 00:00:00").where("status <> 'SUPERSEDED'")
    latest = now.join(registry.latest_version(spark, SF).select("version_id"), "version_id", "left_semi").select("claim_id")
    assert rows(live) == rows(latest)
