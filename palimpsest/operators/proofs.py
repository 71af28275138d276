"""Packs, proofs and receipts as tables: digests chained from rows to proofs, and checks of each level kept apart.

A pack is what is known of a corpus at one instant: claims, evidence and sources, each row with a pack_id. A proof shows the
claims of one key of a pack. It is no nested document but lines, one for each claim, each piece of its evidence and each of
its successors; lines make the digest of their claim, claims that of the proof, which also covers the pack's digest and the
two instants. So a key may hold any share of the rows: sets are hashed in 65,536 buckets of their own hashes and the buckets
in turn, and every check is a join by claim and an aggregate. Repeated rows count in a digest as often as they occur.

Tables: claims (pack_id, key, claim_id, text, val, status, path, version_id, observed_at, valid_from, valid_until,
supersedes_id); evidence (pack_id, evidence_id, claim_id, version_id, text, start_offset, end_offset); sources (pack_id,
version_id, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.state import instant, valid

PROOF, CLAIM = ["pack_id", "key"], ["pack_id", "key", "claim_id"]
LINE = ["kind", "ref", "text", "val", "version_id", "status", "path", "in_force"]
CHECKS = ("intact", "artifact", "identity", "content", "evidence", "in_force", "observed", "lineage")
TIMES = ("observed_at", "valid_from", "valid_until")


def row_hash(*fields: str | Column) -> Column:
    """A digest of fields as one JSON array of strings, nulls apart from empty texts, times to the microsecond."""

    def text(f: str | Column) -> Column:
        if isinstance(f, str):
            return F.date_format(f, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if f in TIMES else F.col(f).cast("string")
        return f.cast("string")

    return F.sha2(F.to_json(F.array(*map(text, fields))), 256)


def set_digest(rows: DataFrame, by: list[str], h: Column) -> DataFrame:
    """by, digest: of each group's hashes in order, first in buckets of equal beginnings."""
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ","), 256)
    buckets = rows.select(*by, h.alias("_h")).groupBy(*by, F.substring("_h", 1, 4).alias("_bucket")).agg(joined.alias("_h"))
    return buckets.groupBy(*by).agg(joined.alias("digest"))


def pack_digests(claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """pack_id, digest over all that a pack holds, whatever the order of its rows."""
    c = claims.select("pack_id", row_hash(F.lit("claim"), "key", "claim_id", "text", "val", "status", "path", "version_id", *TIMES, "supersedes_id").alias("h"))
    e = evidence.select("pack_id", row_hash(F.lit("evidence"), "evidence_id", "claim_id", "version_id", "text", "start_offset", "end_offset").alias("h"))
    s = sources.select("pack_id", row_hash(F.lit("source"), "version_id", "path").alias("h"))
    return set_digest(c.union(e).union(s), ["pack_id"], F.col("h"))


def _successors(claims: DataFrame) -> DataFrame:
    """CLAIM and successor: the claims of a pack that name another of it as the one they replace."""
    later = claims.where("supersedes_id is not null and supersedes_id <> claim_id").select("pack_id", F.col("supersedes_id").alias("claim_id"), F.col("claim_id").alias("successor"))
    return claims.select(*CLAIM).join(later, ["pack_id", "claim_id"]).select(*CLAIM, "successor").distinct()


def proof_lines(claims: DataFrame, evidence: DataFrame, sources: DataFrame, valid_at: str) -> DataFrame:
    """The lines of the proofs of all keys: CLAIM and LINE, null where a field is not of the line's kind."""
    none = lambda *names: [F.lit(None).cast("string" if n in ("text", "status", "path") else "long" if n in ("val", "version_id") else "boolean").alias(n) for n in names]
    path = sources.select("pack_id", "version_id", F.col("path").alias("_path"))
    own = claims.join(path, ["pack_id", "version_id"], "left").select(*CLAIM, F.lit("claim").alias("kind"), F.col("claim_id").alias("ref"), "text", F.col("val").cast("long").alias("val"), F.col("version_id").cast("long").alias("version_id"), "status", F.coalesce("_path", "path").alias("path"), valid(valid_at).alias("in_force"))
    quoted = evidence.select("pack_id", "claim_id", "evidence_id", "text").join(claims.select(*CLAIM), ["pack_id", "claim_id"])
    quoted = quoted.select(*CLAIM, F.lit("evidence").alias("kind"), F.col("evidence_id").alias("ref"), "text", *none("val", "version_id", "status", "path", "in_force"))
    later = _successors(claims).select(*CLAIM, F.lit("successor").alias("kind"), F.col("successor").alias("ref"), *none(*LINE[2:]))
    return own.union(quoted).union(later)


def claim_digests(lines: DataFrame) -> DataFrame:
    return set_digest(lines, CLAIM, row_hash(*LINE))


def chained(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """PROOF and digest of given lines under the heads (PROOF, pack_digest, valid_at, as_of) that they stand under."""
    entries = set_digest(claim_digests(lines), PROOF, row_hash("claim_id", "digest")).withColumnRenamed("digest", "_entries")
    return heads.join(entries, PROOF, "left").select(*PROOF, row_hash("pack_id", "key", "pack_digest", F.col("valid_at"), F.col("as_of"), "_entries").alias("digest"))


def proof_heads(lines: DataFrame, digests: DataFrame, valid_at: str, as_of: str) -> DataFrame:
    """PROOF, pack_digest, valid_at, as_of (as given texts) and the digest of each proof."""
    heads = lines.select(*PROOF).distinct().join(digests.withColumnRenamed("digest", "pack_digest"), "pack_id").withColumns({"valid_at": F.lit(valid_at), "as_of": F.lit(as_of)})
    return heads.join(chained(lines, heads), PROOF)


def claim_checks(lines: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame, valid_at: str) -> DataFrame:
    """CLAIM, one boolean for identity, content, evidence, in_force and lineage each, and the archive's observed_at.

    Lines of a claim that the pack does not hold under that key fail identity alone, as nothing else can be asked of them.
    What the pack records decides: the flag is recomputed from the claim's window, the status and the successors are the
    pack's, in both directions.
    """
    path = sources.select("pack_id", "version_id", F.col("path").alias("_source"))
    known = claims.join(path, ["pack_id", "version_id"], "left").select(
        *CLAIM, F.struct("text", F.col("val").cast("long").alias("val"), F.col("version_id").cast("long").alias("version_id"), F.coalesce("_source", "path").alias("path")).alias("_is"),
        (F.col("path") == F.coalesce("_source", "path")).alias("_agrees"), F.col("status").alias("_status"), "observed_at", valid(valid_at).alias("_inside"),
    )
    own = lines.where("kind = 'claim'").join(known, CLAIM, "left")
    same = F.struct("text", "val", "version_id", "path").eqNullSafe(F.col("_is")) & F.coalesce("_agrees", F.lit(True))
    told = own.groupBy(*CLAIM).agg(
        F.max(F.col("_is").isNotNull()).alias("identity"), F.min(same).alias("content"), F.min(F.col("in_force").eqNullSafe(F.col("_inside"))).alias("in_force"),
        F.min(F.col("status").eqNullSafe(F.col("_status"))).alias("_same_status"), F.max("_status").alias("_status"), F.max("_is.version_id").alias("_version"), F.max("observed_at").alias("observed_at"),
    )
    real = evidence.select("pack_id", F.col("evidence_id").alias("ref"), F.col("claim_id").alias("_claim"), F.col("version_id").cast("long").alias("_of"), F.col("text").alias("_text"))
    cited = lines.where("kind = 'evidence'").select(*CLAIM, "ref", "text").join(real, ["pack_id", "ref"], "left").join(told.select(*CLAIM, "_version"), CLAIM, "left")
    owned = F.coalesce((F.col("_claim") == F.col("claim_id")) & (F.col("_of") == F.col("_version")) & F.col("text").eqNullSafe(F.col("_text")), F.lit(False))
    cited = cited.groupBy(*CLAIM).agg(F.min(owned).alias("evidence"))
    a = lines.where("kind = 'successor'").select(*CLAIM, F.col("ref").alias("successor"), F.lit(1).alias("_told")).distinct()
    both = a.join(_successors(claims).withColumn("_real", F.lit(1)), [*CLAIM, "successor"], "full_outer")
    both = both.groupBy(*CLAIM).agg(F.min(F.col("_told").isNotNull() & F.col("_real").isNotNull()).alias("_paired"), F.max(F.col("_real").isNotNull()).alias("_replaced"))
    stray = lines.select(*CLAIM).distinct().join(told.select(*CLAIM), CLAIM, "left_anti").select(*CLAIM, F.lit(False).alias("identity"))
    j = told.unionByName(stray, allowMissingColumns=True).join(cited, CLAIM, "left").join(both, CLAIM, "left")
    lineage = F.col("_same_status") & F.coalesce("_paired", F.lit(True)) & ~((F.col("_status") == "CURRENT") & F.coalesce("_replaced", F.lit(False)))
    asked = lambda ok: F.when(F.col("identity"), ok).otherwise(F.lit(True))
    return j.select(*CLAIM, "identity", asked(F.col("content")).alias("content"), asked(F.coalesce("evidence", F.lit(True))).alias("evidence"), asked(F.col("in_force")).alias("in_force"), asked(lineage).alias("lineage"), "observed_at")


def verify_proofs(heads: DataFrame, lines: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame, valid_at: str) -> DataFrame:
    """PROOF, the eight CHECKS, verified and failed (the names of those that failed, in their order).

    intact: the lines have the digest of their head; artifact: the head names the pack's digest; identity, content,
    evidence, in_force, lineage: of every claim shown; observed: no claim shown is later than the head's as_of. A head without
    lines and lines without a head are not intact.
    """
    per = claim_checks(lines, claims, evidence, sources, valid_at)
    tops = lines.select(*PROOF).distinct().join(heads, PROOF, "full_outer")
    late = F.coalesce(F.col("observed_at") > F.concat("as_of", F.when(F.col("as_of").rlike("Z$|[+]"), "").otherwise("Z")).cast("timestamp"), F.lit(False))
    told = per.join(heads.select(*PROOF, "as_of"), PROOF, "left").groupBy(*PROOF).agg(*[F.min(c).alias(c) for c in ("identity", "content", "evidence", "in_force", "lineage")], F.min(~late).alias("observed"))
    now, packs = chained(lines, heads).withColumnRenamed("digest", "_now"), pack_digests(claims, evidence, sources).withColumnRenamed("digest", "_pack")
    j = tops.join(told, PROOF, "left").join(now, PROOF, "left").join(packs, "pack_id", "left")
    ok = {"intact": F.col("digest") == F.col("_now"), "artifact": F.col("pack_digest") == F.col("_pack")}
    ok |= {name: F.col(name) for name in CHECKS[2:]}
    ok = {name: F.coalesce(test, F.lit(name not in ("intact", "artifact"))) for name, test in ok.items()}
    failed = F.array_join(F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in ok.items()])), ",")
    return j.select(*PROOF, *[test.alias(name) for name, test in ok.items()], (failed == "").alias("verified"), failed.alias("failed"))


def receipts(lines: DataFrame, heads: DataFrame, claims: DataFrame, queries: DataFrame, valid_at: str, as_of: str) -> DataFrame:
    """One receipt for each key that has a current claim: what is answered at the two instants, named by its own digest.

    queries: pack_id, query. The answer is the claim inside its window at valid_at, a current one first, then by id; without
    one the latest observed by as_of, a current one first among equals; without that the current one. A receipt holds the
    digest of its claim's lines and of the whole proof.
    """
    inside, current = valid(valid_at), F.col("status") == "CURRENT"
    seen = F.col("observed_at") <= instant(as_of)
    tier = F.when(inside, 2).when(seen, 1).otherwise(0)
    rank = F.struct(tier.alias("a"), F.when(tier == 1, F.col("observed_at")).alias("b"), current.alias("c"))
    best = claims.groupBy(*PROOF).agg(F.max(rank).alias("_best"), F.max(current).alias("_any")).where("_any")
    first = claims.withColumn("_rank", rank).join(best, PROOF).where(F.col("_rank").eqNullSafe(F.col("_best"))).groupBy(*PROOF).agg(F.min("claim_id").alias("claim_id"))
    told = lines.where("kind = 'claim'").select(*CLAIM, *LINE[2:])
    r = first.join(told, CLAIM).join(claim_digests(lines).withColumnRenamed("digest", "lines_digest"), CLAIM)
    r = r.join(heads.select(*PROOF, "pack_digest", F.col("digest").alias("proof_digest")), PROOF).join(queries, "pack_id")
    r = r.withColumn("query_digest", F.sha2("query", 256))
    return r.withColumn("receipt_id", receipt_id())


def receipt_id() -> Column:
    return row_hash("query", "query_digest", *CLAIM, *LINE[2:], "lines_digest", "pack_digest", "proof_digest")


def verify_receipts(given: DataFrame, proofs: DataFrame, heads: DataFrame, lines: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame, valid_at: str) -> DataFrame:
    """CLAIM and four verdicts on each receipt, kept apart; proofs are the checks of verify_proofs.

    integrity: receipt and query have their digests, the pack is the one named, and the embedded proof (its digest and that of
    the claim's lines) is there and verified; provenance: claim, value, version, path and evidence are the pack's; temporal:
    the claim is inside its window at valid_at; supersession: status and successors are the pack's.
    """
    per = claim_checks(lines, claims, evidence, sources, valid_at)
    own = claims.select(*CLAIM, F.struct("text", F.col("val").cast("long").alias("val"), F.col("version_id").cast("long").alias("version_id")).alias("_is"), F.col("status").alias("_status"), valid(valid_at).alias("_inside"))
    path = sources.select("pack_id", "version_id", F.col("path").alias("_source"))
    packs = pack_digests(claims, evidence, sources).withColumnRenamed("digest", "_pack")
    j = given.join(own, CLAIM, "left").join(path, ["pack_id", "version_id"], "left").join(packs, "pack_id", "left")
    j = j.join(per.select(*CLAIM, F.col("evidence").alias("_evidence"), F.col("lineage").alias("_lineage")), CLAIM, "left")
    j = j.join(proofs.select(*PROOF, F.col("verified").alias("_verified")), PROOF, "left").join(heads.select(*PROOF, F.col("digest").alias("_proof")), PROOF, "left")
    j = j.join(claim_digests(lines).withColumnRenamed("digest", "_lines"), CLAIM, "left")
    tests = {
        "integrity": (receipt_id() == F.col("receipt_id")) & (F.sha2("query", 256) == F.col("query_digest")) & (F.col("_pack") == F.col("pack_digest")) & F.col("_verified") & (F.col("_proof") == F.col("proof_digest")) & (F.col("_lines") == F.col("lines_digest")),
        "provenance": F.struct("text", "val", "version_id").eqNullSafe(F.col("_is")) & (F.col("path") == F.coalesce("_source", "path")) & F.col("_evidence"),
        "temporal": F.col("_inside"), "supersession": F.col("status").eqNullSafe(F.col("_status")) & F.col("_lineage"),
    }
    return j.select(*CLAIM, *[F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()])


def verify_bundles(bundles: DataFrame, checked: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame, queries: DataFrame) -> DataFrame:
    """bundles (pack_id, pack_digest, query_digest) with their checked receipts -> how many were checked and failed, pack and
    query bound, verified. A bundle without receipts is judged by its bindings."""
    bad = ~(F.col("integrity") & F.col("provenance") & F.col("temporal") & F.col("supersession"))
    counts = checked.groupBy("pack_id").agg(F.count("*").alias("receipts_checked"), F.count_if(bad).alias("n_failed"))
    now = pack_digests(claims, evidence, sources)
    j = bundles.join(counts, "pack_id", "left").join(now, "pack_id", "left").join(queries, "pack_id", "left").na.fill(0, ["receipts_checked", "n_failed"])
    pack_ok, query_ok = F.coalesce(F.col("digest") == F.col("pack_digest"), F.lit(False)), F.coalesce(F.sha2("query", 256) == F.col("query_digest"), F.lit(False))
    return j.select("pack_id", "receipts_checked", "n_failed", pack_ok.alias("pack_bound"), query_ok.alias("query_bound"), (pack_ok & query_ok & (F.col("n_failed") == 0)).alias("verified"))


def pack_problems(packs: DataFrame, claims: DataFrame, refs: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """packs (pack_id, truncated) and refs (pack_id, claim_id, evidence_id) -> pack_id, subject, problem.

    no_evidence: a claim that names none; missing_evidence: one that is not in the pack; missing_source: a claim's version
    without a source; orphan: evidence of a claim that is not there; bad_span: offsets that do not span the quote;
    truncated_empty: a cut pack that kept no current and no conflicting claim.
    """
    one = lambda df, subject, problem: df.select("pack_id", F.col(subject).alias("subject"), F.lit(problem).alias("problem"))
    open_ = claims.where("status in ('CURRENT', 'CONFLICTING')").select("pack_id")
    return (
        one(claims.join(refs, ["pack_id", "claim_id"], "left_anti"), "claim_id", "no_evidence")
        .union(one(refs.join(claims, ["pack_id", "claim_id"], "left_semi").join(evidence, ["pack_id", "evidence_id"], "left_anti"), "claim_id", "missing_evidence"))
        .union(one(claims.join(sources, ["pack_id", "version_id"], "left_anti"), "claim_id", "missing_source"))
        .union(one(evidence.join(claims, ["pack_id", "claim_id"], "left_anti"), "evidence_id", "orphan"))
        .union(one(evidence.where("end_offset - start_offset <> length(text)"), "evidence_id", "bad_span"))
        .union(one(packs.where("truncated").join(open_, "pack_id", "left_anti"), "pack_id", "truncated_empty"))
    )
