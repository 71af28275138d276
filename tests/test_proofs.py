"""Packs, proofs and receipts on a small pack with a chain, a fork and missing fields."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import proofs
from palimpsest.plans import proved

AT, AS_OF = "2024-01-05", "2024-01-10 00:00:00"


@pytest.fixture(scope="module")
def pack(spark):
    rows = [
        ("p", "k", "a", "one", 1, "SUPERSEDED", "x.md", 1, "2024-01-01", None, None, None), ("p", "k", "b", "two", 2, "SUPERSEDED", "x.md", 2, "2024-01-02", "2024-01-02", "2024-01-05", "a"),
        ("p", "k", "c", "three", 3, "CURRENT", "y.md", 3, "2024-01-03", "2024-01-05", None, "a"), ("p", "m", "d", "", None, "SUPERSEDED", "y.md", 3, "2024-01-03", None, None, None),
        ("q", "k", "a", "one", 1, "CURRENT", "x.md", 1, "2024-01-01", "2024-02-01", None, None), (None, None, "z", None, None, None, None, None, None, None, None, None),
    ]
    c = spark.createDataFrame(rows, "pack_id string, key string, claim_id string, text string, val int, status string, path string, version_id long, o string, f string, u string, supersedes_id string")
    c = c.select("*", *[F.to_timestamp(x).alias(n) for x, n in zip("ofu", proofs.TIMES, strict=True)]).drop("o", "f", "u")
    e = spark.createDataFrame([("p", "e1", "a", 1, "one", 0, 3), ("p", "e2", "c", 3, "thr", 0, 3), ("p", "e3", "c", 3, "ee", 3, 5), ("q", "e1", "a", 1, "one", 0, 3)], "pack_id string, evidence_id string, claim_id string, version_id long, text string, start_offset int, end_offset int")
    s = c.where("pack_id is not null").select("pack_id", "version_id", "path").distinct()
    return durable(c.coalesce(1)), durable(e.coalesce(1)), durable(s.coalesce(1))


@pytest.fixture(scope="module")
def made(pack):
    lines = durable(proofs.proof_lines(*pack, AT).coalesce(1))
    return lines, durable(proofs.proof_heads(lines, proofs.pack_digests(*pack), AT, AS_OF).coalesce(1))


def failed(heads, lines, pack):
    return {(r.pack_id, r.key): r.failed for r in proofs.verify_proofs(heads, lines, *pack, AT).where("pack_id is not null").collect()}


def test_lines_show_chain_and_fork(made):
    got = {(r.claim_id, r.kind, r.ref) for r in made[0].where("pack_id = 'p' and key = 'k'").collect()}
    assert got == {("a", "claim", "a"), ("b", "claim", "b"), ("c", "claim", "c"), ("a", "evidence", "e1"), ("c", "evidence", "e2"), ("c", "evidence", "e3"), ("a", "successor", "b"), ("a", "successor", "c")}
    assert {r.claim_id: r.in_force for r in made[0].where("kind = 'claim' and pack_id = 'p'").collect()} == {"a": True, "b": False, "c": True, "d": True}


def test_digests_ignore_order_and_see_every_field(pack):
    c, e, s = pack
    one = lambda *t: {r.pack_id: r.digest for r in proofs.pack_digests(*t).collect()}
    base = one(c, e, s)
    assert one(c.orderBy(F.desc("claim_id")).repartition(3), e, s) == base
    moved = one(c.withColumn("valid_until", F.coalesce("valid_until", F.to_timestamp(F.lit("2025-01-01")))), e, s)
    blank = one(c.withColumn("text", F.nullif("text", F.lit(""))), e, s)
    assert moved["p"] != base["p"] and blank["p"] != base["p"] and blank["q"] == base["q"]
    assert one(c.union(c.where("claim_id = 'd'")), e, s)["p"] != base["p"] and one(*(t.limit(0) for t in pack)) == {}


def test_honest_proofs_verify(pack, made):
    assert failed(made[1], made[0], pack) == {("p", "k"): "", ("p", "m"): "", ("q", "k"): ""}


def test_each_change_is_told_apart(pack, made):
    lines, heads = made
    changed = lambda test, **to: lines.select(*[F.when(F.expr(test), F.expr(to[n])).otherwise(F.col(n)).alias(n) if n in to else n for n in lines.columns])
    cases = {
        "content": changed("kind = 'claim' and claim_id = 'b'", val="9l"), "evidence": changed("kind = 'evidence' and ref = 'e2'", ref="'e1'"), "in_force": changed("kind = 'claim' and claim_id = 'b'", in_force="true"),
        "lineage": lines.where("not (kind = 'successor' and ref = 'c')"), "identity": changed("claim_id = 'b'", claim_id="'d'").where("not (kind = 'claim' and claim_id = 'd' and ref = 'd')"),
    }
    for name, x in cases.items():
        x = durable(x.coalesce(1))
        anew = heads.drop("digest").join(proofs.chained(x, heads), proofs.PROOF)
        assert failed(anew, x, pack)[("p", "k")] == name
    got = failed(heads.withColumn("as_of", F.lit("2024-01-02 12:00:00")), lines, pack)
    assert got[("p", "k")] == "intact,observed" and got[("q", "k")] == "intact"
    assert failed(heads.where("pack_id = 'q'"), lines.where("pack_id = 'p'"), pack)[("q", "k")] == "intact"


def test_receipts_answer_by_tiers(spark, pack, made):
    queries = spark.createDataFrame([("p", "?"), ("q", "")], "pack_id string, query string")
    r = durable(proofs.receipts(*made, pack[0], queries, AT, AS_OF))
    assert {(x.pack_id, x.key): x.claim_id for x in r.collect()} == {("p", "k"): "c", ("q", "k"): "a"}  # inside its window; observed, though not inside
    checked = durable(proofs.verify_proofs(made[1], made[0], *pack, AT))
    ok = proofs.verify_receipts(r, checked, made[1], made[0], *pack, AT)
    assert {x.pack_id: (x.integrity, x.provenance, x.temporal, x.supersession) for x in ok.collect()} == {"p": (True, True, True, True), "q": (True, True, False, True)}
    bundles = proofs.pack_digests(*pack).where("pack_id is not null").withColumnRenamed("digest", "pack_digest").join(queries, "pack_id").select("pack_id", "pack_digest", F.sha2("query", 256).alias("query_digest"))
    got = {x.pack_id: (x.receipts_checked, x.n_failed, x.verified) for x in proofs.verify_bundles(bundles, ok, *pack, queries).collect()}
    assert got == {"p": (1, 0, True), "q": (1, 1, False)}


def test_checks_and_their_sql_of_a_key_without_a_replaced_claim(spark, tmp_path):
    """A single claim of a key that loses its successors, of which it has none: its lineage holds, it is not unknown."""
    rows = [(1, datetime.datetime(2024, 1, 2), 40, "click", 1.0, '{"k": 3}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    d = duckdb.connect()
    d.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = d.sql(f"select pack_id, key, lineage, failed, verified from ({proved.ORACLES['proof_checks']})").fetchall()
    got = proved.proof_checks(spark, str(tmp_path)).select("pack_id", "key", "lineage", "failed", "verified")
    assert list(map(tuple, got.collect())) == want == [("c0", "click.5", True, "", True)]
