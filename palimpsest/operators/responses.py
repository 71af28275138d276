"""Answers held against the archive's authority, whole-chunk envelopes as their baseline, and the claim in force by three tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import relevance
from palimpsest.operators.state import instant, valid

INVARIANTS = ("provenance", "within_budget", "conflict_closed", "current_authority_preserved", "truncated_correct", "temporal_scope_preserved", "status_preserved")


def invariants(responses: DataFrame, returned: DataFrame, full: DataFrame, authority: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id and the seven INVARIANTS of each response, all true for one without claims.

    responses: request_id, characters, budget, truncated; returned: request_id, claim_id, status as returned; full: request_id,
    claim_id of the selection without a budget; authority: claim_id, corpus_id, key, status at the instant asked; evidence:
    claim_id, exact. A conflict is whole where a response that has one of its claims has all; nothing is promoted to CURRENT;
    a response says that it is cut where its claims are not those of the full selection, or where saying that it is not (one
    character more) would not fit. Groups are counted, never gathered.
    """
    quoted = evidence.groupBy("claim_id").agg(F.bool_and("exact").alias("exact"))
    known = authority.select("claim_id", "corpus_id", "key", F.col("status").alias("_status"))
    j = returned.distinct().join(known, "claim_id", "left").join(quoted, "claim_id", "left")
    promoted = (F.col("status") == "CURRENT") & ~F.col("_status").eqNullSafe("CURRENT")
    claims = j.groupBy("request_id").agg(
        F.bool_and(F.coalesce("exact", F.lit(False))).alias("provenance"), F.bool_and(~promoted).alias("current_authority_preserved"),
        F.bool_and(F.col("_status").isNotNull()).alias("temporal_scope_preserved"), F.bool_and(F.col("status").eqNullSafe(F.col("_status"))).alias("status_preserved"),
    )
    sides = known.where("_status = 'CONFLICTING'").groupBy("corpus_id", "key").agg(F.count("*").alias("n_sides"))
    touched = j.where("_status = 'CONFLICTING'").select("request_id", "corpus_id", "key", "claim_id").distinct().groupBy("request_id", "corpus_id", "key").agg(F.count("*").alias("n"))
    closed = touched.join(sides, ["corpus_id", "key"]).groupBy("request_id").agg(F.bool_and(F.col("n") == F.col("n_sides")).alias("conflict_closed"))
    mark = lambda df, name: df.select("request_id", "claim_id").distinct().withColumn(name, F.lit(True))
    both = mark(returned, "_a").join(mark(full, "_b"), ["request_id", "claim_id"], "full_outer")
    dropped = both.groupBy("request_id").agg(F.max(F.col("_a").isNull() | F.col("_b").isNull()).alias("dropped"))
    r = responses.join(claims, "request_id", "left").join(closed, "request_id", "left").join(dropped, "request_id", "left")
    uncut = F.col("characters") + F.col("truncated").cast("int")
    r = r.withColumns({"within_budget": F.col("characters") <= F.col("budget"), "truncated_correct": F.col("truncated") == (F.coalesce("dropped", F.lit(False)) | (uncut > F.col("budget")))})
    return r.select("request_id", *[F.coalesce(name, F.lit(True)).alias(name) for name in INVARIANTS])


def chunk_envelopes(requests: DataFrame, candidates: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Whole chunks as an answer of at most `budget` characters of JSON: {"chunks": [{"path", "text"}], "query", "truncated"}.

    requests: request_id, question; candidates: request_id, id (number), score, path, text. Candidates go in by score, then id; one
    that no longer fits is passed over. Gives the chosen (request_id, id, rank), and per request n_chunks, characters, truncated
    and error: an envelope that does not fit empty has no chunks and null characters. `truncated` is false where all candidates
    are in and that word fits. The envelope itself is the first that is packed, so skip_budget bounds what a request gathers.
    """
    base = requests.select("request_id", F.length(F.to_json(F.struct(F.array().cast("array<string>").alias("chunks"), F.col("question").alias("query"), F.lit(True).alias("truncated")))).alias("base"))
    fits = base.where(F.col("base") <= budget)
    sized = candidates.select("request_id", F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), (F.length(F.to_json(F.struct("path", "text"))) + 1).alias("size")).join(fits.select("request_id"), "request_id", "left_semi")
    envelope = fits.select("request_id", F.lit(-1).cast("long").alias("id"), F.lit(float("inf")).alias("score"), (F.col("base") - 1).alias("size"))
    packed = relevance.skip_budget(envelope.unionByName(sized), "request_id", budget)
    chosen = packed.where("rank > 1").select("request_id", "id", (F.col("rank") - 1).alias("rank"))
    given = candidates.groupBy("request_id").agg(F.count("*").alias("n"))
    used = packed.groupBy("request_id").agg(F.sum("size").alias("used"), (F.count("*") - 1).alias("n_chunks"))
    r = base.join(used, "request_id", "left").join(given, "request_id", "left")
    characters = F.when(F.col("n_chunks") == 0, F.col("base").cast("long")).otherwise(F.col("used"))
    whole = (F.col("n_chunks") == F.coalesce("n", F.lit(0))) & (characters + 1 <= budget)
    error = F.when(F.col("base") > budget, "envelope_exceeds_budget")
    report = r.select("request_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(error.isNull(), characters + whole.cast("int")).alias("characters"), F.when(error.isNull(), ~whole).alias("truncated"), error.alias("error"))
    return chosen, report


def in_force_tiers(resolved: DataFrame, valid_at: str, as_of: str) -> DataFrame:
    """Per (corpus, key) the claim in force and the tier that found it: 1 one whose window holds the instant (a current one first,
    then the earliest), 2 the latest observed by as_of, 3 a current one, or the earliest. Ties go by claim_id."""
    tier = F.when(valid(valid_at), 1).when(F.col("observed_at") <= instant(as_of), 2).otherwise(3)
    at = F.unix_micros(F.col("observed_at").cast("timestamp"))
    latest = tier == 2
    order = F.struct(tier.alias("tier"), F.when(latest, False).otherwise(F.col("status") != "CURRENT").alias("a"), F.when(latest, -at).otherwise(at).alias("b"), F.col("claim_id").alias("claim_id"))
    return resolved.groupBy("corpus_id", "key").agg(F.min(order).alias("x")).select("corpus_id", "key", "x.claim_id", "x.tier")
