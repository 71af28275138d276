"""Closures, peeling, circles and whole answers on small cases against plain Python."""

import datetime
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import closures, projection
from palimpsest.plans import projected

from .conftest import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_conflicts_chain(spark):
    members = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("z", 3), ("z", 4), ("w", 9), ("w", 8), ("w", 8), (None, 1), ("n", None)], "conflict_id string, claim_id long")
    seeds = spark.createDataFrame([(10, 1), (10, 1), (11, 4), (12, 7), (13, 1), (13, 9), (None, 1)], "request_id long, claim_id long")
    want = [(10, 1, 0), (10, 2, 1), (10, 3, 2), (10, 4, 3), (11, 1, 3), (11, 2, 2), (11, 3, 1), (11, 4, 0), (12, 7, 0), (13, 1, 0), (13, 2, 1), (13, 3, 2), (13, 4, 3), (13, 8, 1), (13, 9, 0)]
    assert rows(closures.conflict_closure(seeds, members)) == sorted(want, key=repr)
    assert rows(closures.conflict_closure(seeds.limit(0), members)) == []


def ordered(n, edges):
    """level and component by reachability."""
    edges = {(a, b) for a, b in edges if a != b}
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for a, b in edges:
            for s in reach:
                if a in reach[s]:
                    reach[s].add(b)
    looped = {a for a, b in edges if a in reach[b]}
    rest = {b for a in looped for b in reach[a]}
    name = {a: min(b for b in reach[a] if a in reach[b]) for a in rest}

    def longest(nodes, links):
        level = dict.fromkeys(nodes, 0)
        for _ in nodes:
            for a, b in links:
                level[b] = max(level[b], level[a] + 1)
        return level

    free = longest(set(range(n)) - rest, [(a, b) for a, b in edges if b not in rest])
    behind = longest(set(name.values()), [(name[a], name[b]) for a, b in edges if a in rest and name[a] != name[b]])
    start = max(free.values(), default=-1) + 1
    return sorted([(a, v, None) for a, v in free.items()] + [(a, start + behind[name[a]], name[a]) for a in rest], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_equals_reachability(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    df = spark.createDataFrame([*edges, *edges[:3], (99, 1), (1, 99), (None, 2)], "before long, after long")
    assert rows(closures.ingest_order(spark.createDataFrame([(i,) for i in range(n)] + [(3,), (None,)], "id long"), df)) == ordered(n, edges)


def test_order_without_edges(spark):
    nodes, edges = spark.createDataFrame([(2,), (1,)], "id long"), spark.createDataFrame([], "before long, after long")
    assert rows(closures.ingest_order(nodes, edges)) == [(1, 0, None), (2, 0, None)] and rows(closures.ingest_order(nodes.limit(0), edges)) == []


def test_whole_answers(spark):
    v = spark.createDataFrame([(1, "c", 1, 1, "NEW", "2024-01-01"), (2, "c", 1, 2, "MODIFIED", "2024-01-03"), (3, "c", 2, 1, "NEW", "2024-01-02")], "version_id long, corpus_id string, doc_id long, version_number int, event string, at string").selectExpr("*", "timestamp(concat(at, 'T00:00:00Z')) observed_at").drop("at")
    given = [("a", "p/1", 1, 1, "k", 5, None, "2024-01-01"), ("b", "p/1", 1, 2, "k", 6, "a", "2024-01-03"), ("c", "p/2", 2, 3, "k", 7, None, "2024-01-02"), ("d", "p/2", 2, 3, "m", 1, None, "2024-01-02")]
    c = spark.createDataFrame(given, "claim_id string, path string, doc_id long, version_id long, key string, val int, supersedes_id string, at string").selectExpr("*", "'c' corpus_id", "timestamp(concat(at, 'T00:00:00Z')) observed_at", "cast(null as timestamp) valid_from", "cast(null as timestamp) valid_until").drop("at")
    e = spark.createDataFrame([("b", 0, 3), ("b", 5, 9), ("d", 1, 2)], "claim_id string, start_offset int, end_offset int")
    asked = spark.createDataFrame([(1, "c", "2024-01-05", None), (2, "c", "2024-01-05", None), (3, "c", "2024-01-05", "p/2"), (4, "c", "2024-01-01", None), (5, "x", "2024-01-05", None), (6, "c", "2023-01-01", "p/1")], "request_id long, corpus_id string, at string, path string").selectExpr("request_id", "corpus_id", "timestamp(concat(at, 'T00:00:00Z')) as_of", "path")
    got = {r.request_id: r.answer.asDict(True) for r in projection.project(asked, v, c, e).collect()}
    assert got[1] == got[2] and got[1]["state"] == "conflicting" and got[1]["conflicts"] == [{"key": "k", "sides": ["b", "c"]}] and got[1]["sources"] == [2, 3]
    one, two = got[1]["documents"]
    assert [x["claim_id"] for x in one["historical"]] == ["a"] and one["current"] == [] and [x["claim_id"] for x in two["current"]] == ["d"] and one["path"] == "p/1"
    assert got[3]["state"] == "current" and got[3]["conflicts"] == [] and [(x["claim_id"], len(x["evidence"])) for x in got[3]["documents"][0]["current"]] == [("c", 0), ("d", 1)]
    assert got[4]["state"] == "current" and [x["claim_id"] for x in got[4]["documents"][0]["current"]] == ["a"]
    assert got[5] == got[6] == {"state": "unknown", "documents": [], "conflicts": [], "sources": []}


def test_closures_and_their_sql_follow_long_chains(spark, tmp_path):
    """One key's values by fives: every claim conflicts with its neighbours only, nineteen rounds from end to end."""
    rows = [(i, datetime.datetime(2024, 1, 1 + i), 0, "click", 1.0, f'{{"k": {5 * i}}}') for i in range(20)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    d = duckdb.connect()
    d.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, projected.conflict_closures(spark, str(tmp_path)).select("request_id", "claim_id", "round").collect()))
    assert got == sorted(d.sql(projected.ORACLES["conflict_closures"]).fetchall()) and len(got) == 400 and max(r[2] for r in got) == 19


def test_answers_are_one_a_scope(spark):
    """Many requests for one scope share its answer, which is digested before it is copied."""
    v = spark.createDataFrame([("c0", 1, 10, 1, "NEW", 1)], "corpus_id string, doc_id long, version_id long, version_number int, event string, observed_at int").withColumn("observed_at", F.timestamp_seconds("observed_at"))
    c = spark.createDataFrame([("a", "c0", 1, "p", "k", 5, 10, 1)], "claim_id string, corpus_id string, doc_id long, path string, key string, val int, version_id long, observed_at int")
    c = c.withColumns({"observed_at": F.timestamp_seconds("observed_at"), "supersedes_id": F.lit(None).cast("string"), "valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp")})
    e = spark.createDataFrame([("a", 0, 1)], "claim_id string, start_offset int, end_offset int")
    asked = spark.range(100).select(F.col("id").alias("request_id"), F.lit("c0").alias("corpus_id"), F.timestamp_seconds(F.lit(9)).alias("as_of"), F.when(F.col("id") % 2 == 0, "p").alias("path"))
    found = projection.answers(asked, v, c, e)
    assert sorted((r.path, r.answer.state, len(r.answer.documents)) for r in found.collect()) == [("", "current", 1), ("p", "current", 1)]
    assert projection.to_requests(asked, found.select(*projection.SCOPE, "answer.state")).groupBy("state").count().collect() == [("current", 100)]


def test_digests_are_of_whole_answers(spark):
    """Streamed digests equal those of nested answers; no row of the way there holds more than a piece of a corpus' answer."""
    rng = random.Random(3)
    v = [(f"c{i % 2}", i % 12, i, i // 12 + 1, rng.choice(["NEW", "MODIFIED", "MODIFIED", "DELETED"]), i // 12) for i in range(60)]
    c = [(f"{n:02}{'é' * rng.randrange(3)}:{k}", corpus, doc, f'p"{doc % 5}', f"k{rng.randrange(6)}", rng.randrange(3), n, at) for corpus, doc, n, _, event, at in v if event != "DELETED" for k in range(3)]
    c = [(*x, rng.choice([None, None, y[0]]) if x[1] == y[1] else None) for x, y in zip(c, [*c[3:], *c[:3]], strict=True)]
    v = spark.createDataFrame(v, "corpus_id string, doc_id long, version_id long, version_number int, event string, at int").select("*", F.timestamp_seconds("at").alias("observed_at")).drop("at")
    c = spark.createDataFrame(c, "claim_id string, corpus_id string, doc_id long, path string, key string, val int, version_id long, at int, supersedes_id string")
    c = c.select("*", F.timestamp_seconds("at").alias("observed_at"), F.when(F.col("val") == 1, F.timestamp_seconds("at")).alias("valid_from"), F.when(F.col("val") == 2, F.timestamp_seconds(F.col("at") + 2)).alias("valid_until")).drop("at")
    e = c.where("val > 0").select("claim_id", F.explode(F.array(F.lit(5), F.lit(1))).alias("start_offset"), F.lit(9).alias("end_offset"))
    asked = [(f"c{i}", at, path) for i in range(3) for at in (-1, 0, 2, 9) for path in (None, 'p"0', 'p"1', 'p"4', "none")]
    asked = spark.createDataFrame(asked, "corpus_id string, at int, path string").select("corpus_id", F.timestamp_seconds("at").alias("as_of"), "path")
    want = projection.answers(asked, v, c, e).select(*projection.SCOPE, "answer.state", F.size("answer.documents"), F.size("answer.conflicts"), F.sha2(F.to_json("answer"), 256))
    got = projection.digests(asked, v, c, e)
    assert rows(got) == rows(want) and got.count() == 60 and {r.state for r in got.where("path <> ''").collect()} == {"conflicting", "current", "unknown"}


def test_a_corpus_is_one_row_nowhere(spark):
    n = 4_000
    v = spark.range(n).select(F.lit("c").alias("corpus_id"), F.col("id").alias("doc_id"), F.col("id").alias("version_id"), F.lit(1).alias("version_number"), F.lit("NEW").alias("event"), F.timestamp_seconds(F.lit(1)).alias("observed_at"))
    c = v.select(F.col("doc_id").cast("string").alias("claim_id"), "corpus_id", "doc_id", F.format_string("p%05d", "doc_id").alias("path"), F.lit("k").alias("key"), F.lit(1).alias("val"), "version_id", "observed_at", F.lit(None).cast("string").alias("supersedes_id"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    e = c.select("claim_id", F.lit(0).alias("start_offset"), F.lit(projection.PIECE).alias("end_offset"))
    asked = spark.createDataFrame([("c", None)], "corpus_id string, path string").withColumn("as_of", F.timestamp_seconds(F.lit(9)))
    found = projection.digests(asked, v, c, e)
    answer = '{"state":"current","documents":[' + ",".join(f'{{"path":"p{i:05}","current":[{{"key":"k","claim_id":"{i}","val":1,"evidence":[{{"start_offset":0,"end_offset":{projection.PIECE}}}]}}],"historical":[],"uncertain":[]}}' for i in range(n)) + '],"conflicts":[],"sources":[' + ",".join(map(str, range(n))) + "]}"
    assert "flatten" not in projected.projected_answers(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found.select("state", "n_documents", "n_conflicts", "digest")) == [("current", n, 0, hashlib.sha256(answer.encode()).hexdigest())]
