"""Registered queries of packs, proofs and receipts with their checks, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import proofs
from palimpsest.plans.registry import EARLY, NOW, _resolved, status_sql
from palimpsest.sources import archive


def _number() -> Column:
    """Keys are <kind>.<number>: what is planted goes by their number."""
    return F.split("key", r"\.")[1].cast("int")


def _pack(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pack a corpus: all claims observed by now, with their evidence and sources, as every check reads them several times."""
    r = _resolved(spark, d)
    claims = r.select(F.col("corpus_id").alias("pack_id"), "key", "claim_id", F.col("claim").alias("text"), "val", "status", "path", "version_id", *proofs.TIMES, "supersedes_id")
    claims = durable(claims)
    quoted = archive.evidence(archive.claims(archive.versions(spark, d))).select("claim_id", F.col("quote").alias("text"), "start_offset", "end_offset")
    evidence = durable(claims.select("pack_id", "claim_id", "version_id").join(quoted, "claim_id").withColumn("evidence_id", F.concat(F.lit("e"), "claim_id")))
    return claims, evidence, claims.select("pack_id", "version_id", "path").distinct()


def _queries(claims: DataFrame) -> DataFrame:
    return claims.select("pack_id").distinct().withColumn("query", F.concat(F.lit("what is known of "), "pack_id"))


def pack_digests(spark: SparkSession, d: str) -> DataFrame:
    return proofs.pack_digests(*_pack(spark, d))


def _proofs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    pack = _pack(spark, d)
    lines = durable(proofs.proof_lines(*pack, EARLY))
    return lines, durable(proofs.proof_heads(lines, proofs.pack_digests(*pack), EARLY, NOW)), pack


def chained_proofs(spark: SparkSession, d: str) -> DataFrame:
    lines, heads, _ = _proofs(spark, d)
    n = lines.groupBy(*proofs.PROOF).agg(F.count("*").alias("n_lines"))
    return heads.join(n, proofs.PROOF).select("pack_id", "key", "n_lines", "digest")


def proof_checks(spark: SparkSession, d: str) -> DataFrame:
    """Proofs of which some were changed: by the number of the key one kind of line, in claims with a value divisible by
    three; some digests were made anew afterwards; those of one pack name another pack's digest."""
    lines, heads, pack = _proofs(spark, d)
    kind, t, hit = F.col("kind"), _number() % 8, F.col("_v") % 3 == 0
    x = lines.join(pack[0].select(*proofs.CLAIM, F.col("val").alias("_v")), proofs.CLAIM)
    x = x.where(~((t == 5) & hit & (kind == "successor"))).select(
        "pack_id", "key", F.when((t == 6) & hit, F.concat("claim_id", F.lit("x"))).otherwise(F.col("claim_id")).alias("claim_id"), "kind",
        F.when((t == 2) & hit & (kind == "evidence"), F.concat("ref", F.lit("x"))).otherwise(F.col("ref")).alias("ref"), F.when((t == 1) & hit & (kind == "claim"), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), "val", "version_id",
        F.when((t == 4) & hit & (kind == "claim"), "CURRENT").otherwise(F.col("status")).alias("status"), "path", F.when((t == 3) & hit, ~F.col("in_force")).otherwise(F.col("in_force")).alias("in_force"),
    )
    given = heads.withColumns({"as_of": F.when(t == 7, EARLY).otherwise(F.col("as_of")), "pack_digest": F.when(F.col("pack_id") == "c3", F.sha2("pack_digest", 256)).otherwise(F.col("pack_digest"))})
    anew = proofs.chained(x, given.drop("digest")).withColumnRenamed("digest", "_anew")
    given = given.join(anew, proofs.PROOF).withColumn("digest", F.when((F.floor(_number() / 8) % 2 == 1) | (t == 7), F.col("_anew")).otherwise(F.col("digest"))).drop("_anew")
    return proofs.verify_proofs(given, x, *pack, EARLY)


def _receipts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    lines, heads, pack = _proofs(spark, d)
    return proofs.receipts(lines, heads, pack[0], _queries(pack[0]), EARLY, NOW), lines, heads, pack


def key_receipts(spark: SparkSession, d: str) -> DataFrame:
    return _receipts(spark, d)[0].select("pack_id", "key", "claim_id", "status", "in_force", "proof_digest", "receipt_id")


def _verdicts(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    r, lines, heads, pack = _receipts(spark, d)
    t = _number() % 8
    r = r.withColumns({
        "text": F.when(t == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "path": F.when(t == 2, F.lit("users/none.md")).otherwise(F.col("path")),
        "proof_digest": F.when(t == 3, F.sha2("proof_digest", 256)).otherwise(F.col("proof_digest")), "status": F.when(t == 4, "SUPERSEDED").otherwise(F.col("status")),
    })
    given = r.withColumn("receipt_id", F.when(t.isin(2, 3, 4), proofs.receipt_id()).otherwise(F.col("receipt_id")))
    checked = durable(proofs.verify_proofs(heads, lines, *pack, EARLY))
    return proofs.verify_receipts(given, checked, heads, lines, *pack, EARLY), pack


def receipt_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of which some were changed by the number of their key, most of these with a new digest of their own."""
    return _verdicts(spark, d)[0]


def response_bundles(spark: SparkSession, d: str) -> DataFrame:
    """One bundle a pack: the receipts of all its keys; that of one pack was made for another question."""
    checked, pack = _verdicts(spark, d)
    queries = _queries(pack[0])
    made = proofs.pack_digests(*pack).withColumnRenamed("digest", "pack_digest").join(queries, "pack_id")
    bundles = made.select("pack_id", "pack_digest", F.sha2(F.when(F.col("pack_id") == "c2", F.concat("query", F.lit("?"))).otherwise(F.col("query")), 256).alias("query_digest"))
    return proofs.verify_bundles(bundles, checked, *pack, queries)


def pack_self_checks(spark: SparkSession, d: str) -> DataFrame:
    """Packs that lack claims, references, evidence and sources by value, and cut packs of superseded claims alone."""
    claims, evidence, sources = _pack(spark, d)
    old = lambda df: df.withColumn("pack_id", F.concat(F.lit("old-"), "pack_id"))
    past = claims.where("status = 'SUPERSEDED'")
    refs = evidence.select("pack_id", "claim_id", "evidence_id").join(claims.select("claim_id", "val"), "claim_id")
    e = evidence.join(claims.select("claim_id", "val"), "claim_id").where("val % 30 <> 1").withColumn("end_offset", F.col("end_offset") + F.when(F.col("val") % 60 == 3, 1).otherwise(0))
    c = claims.where("val % 40 <> 2").unionByName(old(past))
    past = past.select("pack_id", "claim_id", "version_id")
    own = evidence.join(past, ["pack_id", "claim_id", "version_id"], "left_semi")
    return proofs.pack_problems(
        c.select("pack_id").distinct().withColumn("truncated", F.lit(True)), c, refs.where("val % 50 <> 0").drop("val").unionByName(old(own.select("pack_id", "claim_id", "evidence_id"))),
        e.drop("val").unionByName(old(own)), sources.where("version_id % 40 <> 0").unionByName(old(sources)),
    )


def _hash(*fields: str) -> str:
    return "sha256(cast(to_json([" + ", ".join(f"cast({f} as varchar)" for f in fields) + "]) as varchar))"


def _set(rows: str, by: str) -> str:
    return f"select {by}, sha256(string_agg(g, ',' order by g)) digest from (select {by}, left(h, 4) b, sha256(string_agg(h, ',' order by h)) g from {rows} group by {by}, left(h, 4)) x group by {by}"


def _chain(lines: str, heads: str, out: str) -> str:
    fields = ("kind", "ref", "txt", "val", "version_id", "status", "path", "in_force")
    return f""", {out}a as materialized ({_set(f"(select pack_id, key, claim_id, {_hash(*fields)} h from {lines}) y", "pack_id, key, claim_id")}),
{out}b as materialized ({_set(f"(select pack_id, key, {_hash('claim_id', 'digest')} h from {out}a) y", "pack_id, key")}),
{out} as materialized (select pack_id, key, {_hash("pack_id", "key", "pack_digest", "valid_at", "as_of", "digest")} digest from {heads} left join {out}b using (pack_id, key))"""


_AT = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_INSIDE = f"coalesce(valid_from <= timestamp '{EARLY}', true) and coalesce(timestamp '{EARLY}' < valid_until, true)"
_PACK = status_sql(NOW) + f""", ch as (select version_id, string_agg(claim, chr(10) order by key, claim) chunk from c group by 1),
pc as materialized (select corpus_id pack_id, key, cast(split_part(key, '.', 2) as int) n, claim_id, claim txt, val, status, path, version_id, observed_at, valid_from, valid_until, supersedes_id, {_INSIDE} inside from s),
pe as materialized (select pack_id, key, n, val, 'e' || claim_id evidence_id, claim_id, version_id, txt, strpos(chunk, txt) - 1 so, strpos(chunk, txt) - 1 + length(txt) eo from pc join ch using (version_id)),
ps as materialized (select distinct pack_id, version_id, path from pc),
pd as materialized ({_set(f'''(select pack_id, {_hash("'claim'", "key", "claim_id", "txt", "val", "status", "path", "version_id", *[_AT.format(t) for t in proofs.TIMES], "supersedes_id")} h from pc
 union all select pack_id, {_hash("'evidence'", "evidence_id", "claim_id", "version_id", "txt", "so", "eo")} from pe union all select pack_id, {_hash("'source'", "version_id", "path")} from ps) y''', "pack_id")})
"""
_PROOFS = _PACK + f""", ln as materialized (select pack_id, key, n, val v, claim_id, 'claim' kind, claim_id ref, txt, cast(val as bigint) val, version_id, status, path, inside in_force from pc
 union all select pack_id, key, n, val, claim_id, 'evidence', evidence_id, txt, null, null, null, null, null from pe
 union all select a.pack_id, a.key, a.n, a.val, a.claim_id, 'successor', b.claim_id, null, null, null, null, null, null from pc a join pc b on b.pack_id = a.pack_id and b.supersedes_id = a.claim_id),
hd as materialized (select distinct pack_id, key, n, digest pack_digest, '{EARLY}' valid_at, '{NOW}' as_of from pc join pd using (pack_id))
""" + _chain("ln", "hd", "pr")
_RECEIPTS = _PROOFS + f""", ti as (select *, case when inside then 2 when observed_at <= timestamp '{NOW}' then 1 else 0 end tier from pc),
fi as (select * from (select *, bool_or(status = 'CURRENT') over (partition by pack_id, key) any_current, row_number() over (partition by pack_id, key order by tier desc, case when tier = 1 then observed_at end desc nulls last, (status = 'CURRENT') desc, claim_id) r from ti) x where r = 1 and any_current),
rc as materialized (select fi.*, 'what is known of ' || pack_id q, pra.digest lines_digest, pd.digest pack_digest, pr.digest proof_digest from fi join pra using (pack_id, key, claim_id) join pd using (pack_id) join pr using (pack_id, key)),
"""
_VERDICTS = _RECEIPTS + """ rv as materialized (select pack_id, key, claim_id, n % 8 not in (1, 3) integrity, n % 8 not in (1, 2) provenance, inside temporal, n % 8 <> 4 or status = 'SUPERSEDED' supersession from rc)
"""
ORACLES = {
    "pack_digests": _PACK + "select pack_id, digest from pd",
    "chained_proofs": _PROOFS + "select pack_id, key, n_lines, digest from pr join (select pack_id, key, count(*) n_lines from ln group by all) x using (pack_id, key)",
    "proof_checks": _PROOFS + f""", lx as materialized (select pack_id, key, n, case when n % 8 = 6 and v % 3 = 0 then claim_id || 'x' else claim_id end claim_id, kind, case when n % 8 = 2 and v % 3 = 0 and kind = 'evidence' then ref || 'x' else ref end ref,
 case when n % 8 = 1 and v % 3 = 0 and kind = 'claim' then txt || '!' else txt end txt, val, version_id, case when n % 8 = 4 and v % 3 = 0 and kind = 'claim' then 'CURRENT' else status end status, path, case when n % 8 = 3 and v % 3 = 0 then not in_force else in_force end in_force
 from ln where not (n % 8 = 5 and v % 3 = 0 and kind = 'successor')),
hx as materialized (select pack_id, key, n, case when pack_id = 'c3' then sha256(pack_digest) else pack_digest end pack_digest, valid_at, case when n % 8 = 7 then '{EARLY}' else as_of end as_of from hd)
{_chain("lx", "hx", "px")}, fl as (select pack_id, key, any_value(n) n, bool_or(val % 3 = 0) hit, bool_or(val % 3 = 0 and status <> 'CURRENT') other, bool_or(val % 3 = 0 and claim_id in (select supersedes_id from pc where supersedes_id is not null)) replaced, bool_or(observed_at > timestamp '{EARLY}') late from pc group by 1, 2),
ck as (select pack_id, key, (n // 8) % 2 = 1 or n % 8 = 7 or px.digest = pr.digest intact, pack_id <> 'c3' artifact, not (n % 8 = 6 and hit) identity, not (n % 8 = 1 and hit) content, not (n % 8 = 2 and hit) evidence,
 not (n % 8 = 3 and hit) in_force, not (n % 8 = 7 and late) observed, not (n % 8 = 4 and other) and not (n % 8 = 5 and replaced) lineage from fl join px using (pack_id, key) join pr using (pack_id, key))
select *, concat_ws(',', {", ".join(f"case when not {c} then '{c}' end" for c in proofs.CHECKS)}) failed, failed = '' verified from ck""",
    "key_receipts": _RECEIPTS + f"z as (select 1) select pack_id, key, claim_id, status, inside in_force, proof_digest, {_hash('q', 'sha256(q)', 'pack_id', 'key', 'claim_id', 'txt', 'val', 'version_id', 'status', 'path', 'inside', 'lines_digest', 'pack_digest', 'proof_digest')} receipt_id from rc",
    "receipt_verdicts": _VERDICTS + "select * from rv",
    "response_bundles": _VERDICTS + "select *, pack_bound and query_bound and n_failed = 0 verified from (select pack_id, count(*) receipts_checked, count(*) filter (where not (integrity and provenance and temporal and supersession)) n_failed, true pack_bound, pack_id <> 'c2' query_bound from rv group by 1) x",
    "pack_self_checks": _PACK + """, cl as (select pack_id, claim_id, val, version_id, status from pc where val % 40 <> 2)
select pack_id, claim_id subject, 'no_evidence' problem from cl where val % 50 = 0 union all select pack_id, claim_id, 'missing_evidence' from cl where val % 30 = 1 and val % 50 <> 0
union all select pack_id, claim_id, 'missing_source' from cl where version_id % 40 = 0 union all select pack_id, evidence_id, 'orphan' from pe where val % 40 = 2 and val % 30 <> 1
union all select pack_id, evidence_id, 'bad_span' from pe where val % 60 = 3 and val % 30 <> 1 union all select distinct 'old-' || pack_id, 'old-' || pack_id, 'truncated_empty' from pc where status = 'SUPERSEDED'""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
