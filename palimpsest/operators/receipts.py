"""Receipts of answers and of decisions: built as canonical JSON with a digest, and held against the archive by separate checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import gates, state

VERSION = 1


def canonical(*fields: str) -> Column:
    """Columns as one JSON object, by name, nulls kept, no white space."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def answer_receipts(resolved: DataFrame, evidence: DataFrame, valid_at: str, as_of: str) -> DataFrame:
    """One receipt a (corpus, key): the claim in force at the instant, with its status, quote and offsets.

    resolved: claims with status; evidence: claim_id, quote, start_offset, end_offset (one row a claim). Gives receipt_id,
    body and the fields of the body.
    """
    best = state.in_force(resolved, valid_at, as_of).select("claim_id", "inside")
    held = best.join(resolved.select("claim_id", "corpus_id", "key", "claim", "status", "version_id"), "claim_id")
    quoted = held.join(evidence.select("claim_id", "quote", "start_offset", "end_offset"), "claim_id", "left")
    body = canonical("claim_id", "corpus_id", "key", "claim", "status", "version_id", "inside", "quote", "start_offset", "end_offset")
    return quoted.withColumn("body", body).withColumn("receipt_id", F.sha2("body", 256))


def verify_answers(receipts: DataFrame, resolved: DataFrame, chunks: DataFrame, valid_at: str) -> DataFrame:
    """Four verdicts on each receipt (receipt_id, body), kept apart; a null one means that it could not be asked.

    integrity: the body has the digest it is named by; provenance: its quote stands at its offsets in its version's chunk
    (version_id, chunk); temporal: the claim is inside its window at the instant as recorded; supersession: its status is
    still the recorded one.
    """
    read = "claim_id string, status string, version_id bigint, inside boolean, quote string, start_offset int, end_offset int"
    r = receipts.withColumn("r", F.from_json("body", read)).select("receipt_id", "body", "r.*")
    now = resolved.select("claim_id", F.col("status").alias("_status"), state.valid(valid_at).alias("_inside"))
    j = r.join(now, "claim_id", "left").join(chunks.select("version_id", "chunk").distinct(), "version_id", "left")
    cut = F.expr("substring(chunk, start_offset + 1, end_offset - start_offset)")
    return j.select(
        "receipt_id", (F.sha2("body", 256) == F.col("receipt_id")).alias("integrity"), F.coalesce(cut == F.col("quote"), F.lit(False)).alias("provenance"),
        (F.col("_inside") == F.col("inside")).alias("temporal"), (F.col("_status") == F.col("status")).alias("supersession"),
    )


def decision_receipts(candidates: DataFrame, threshold: float) -> DataFrame:
    """question_id -> fingerprint and body of the decision over its candidates (question_id, item_id, relevance, overlap)."""
    made = gates.decide(candidates, threshold).withColumns({"threshold": F.lit(threshold), "version": F.lit(VERSION)})
    body = canonical("question_id", "selected_id", "abstained", "threshold", "version")
    return made.select("question_id", body.alias("body"), F.sha2(body, 256).alias("fingerprint"))


def replay_decisions(given: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Receipts (question_id, body, fingerprint) decided again: damaged, gone, changed or same."""
    again = decision_receipts(candidates, threshold).select("question_id", F.col("fingerprint").alias("_now"))
    j = given.join(again, "question_id", "left")
    outcome = F.when(F.sha2("body", 256) != F.col("fingerprint"), "damaged").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("fingerprint"), "changed").otherwise("same")
    return j.select("question_id", outcome.alias("outcome"))
