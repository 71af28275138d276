"""Walks over supersession edges, each claim superseding at most one, and revalidation of stored references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable


def levels(c: DataFrame) -> DataFrame:
    """(claim_id, supersedes_id) -> level: how many claims lie before it; null on a cycle or behind one, to come last.

    Pointer doubling: rounds grow with log(depth), and end with log(claims) where a cycle has no end.
    """
    known = c.select("claim_id")
    up = c.join(known.select(F.col("claim_id").alias("supersedes_id")), "supersedes_id", "left_semi").select("claim_id", "supersedes_id")
    p = durable(known.join(up, "claim_id", "left").select("claim_id", F.col("supersedes_id").alias("to"), F.col("supersedes_id").isNotNull().cast("long").alias("level")))
    n, reach = p.where("to is not null").count(), 1
    while reach <= 2 * n and not p.where("to is not null").isEmpty():
        far = p.select(F.col("claim_id").alias("to"), F.col("to").alias("_to"), F.col("level").alias("_level"))
        p = durable(p.join(far, "to", "left").select("claim_id", F.col("_to").alias("to"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")))
        reach *= 2
    return p.select("claim_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))


def heads(c: DataFrame) -> DataFrame:
    """(claim_id, head_id): the terminal successors of every superseded claim; head_id is null where a cycle has none.

    A claim supersedes at most one, so walking back from the heads is a forest: each round doubles the step, which takes
    log(depth) rounds. Claims that are superseded but reach no head lie on a cycle or before one.
    """
    edge = durable(c.where("supersedes_id is not null").select(F.col("claim_id").alias("at"), F.col("supersedes_id").alias("before")))
    tips = c.join(edge.select(F.col("before").alias("claim_id")), "claim_id", "left_anti").select(F.col("claim_id").alias("head_id"))
    # out holds (head, ancestor) at distances below some power of two; jump leads over just that distance
    out = durable(tips.select("head_id", F.col("head_id").alias("at")))
    jump, more = edge, True
    while more:
        step = durable(out.join(jump, "at").select("head_id", F.col("before").alias("at")).distinct().join(out, ["head_id", "at"], "left_anti"))
        more = not step.isEmpty()
        if more:
            out = durable(out.union(step))
            jump = durable(jump.join(jump.select(F.col("at").alias("before"), F.col("before").alias("_far")), "before").select("at", F.col("_far").alias("before")))
    found = out.where("head_id <> at").select(F.col("at").alias("claim_id"), "head_id")
    superseded = c.select("claim_id").join(edge.select(F.col("before").alias("claim_id")).distinct(), "claim_id", "left_semi")
    lost = superseded.join(found.select("claim_id").distinct(), "claim_id", "left_anti")
    return found.union(lost.select("claim_id", F.lit(None).cast("string").alias("head_id")))


def revalidate(refs: DataFrame, c: DataFrame, live_versions: DataFrame) -> DataFrame:
    """(artifact, claim_id) -> superseded, retired (its version is no longer live), missing or current."""
    known = c.select("claim_id", "version_id")
    gone = c.where("supersedes_id is not null").select(F.col("supersedes_id").alias("claim_id"), F.lit(True).alias("gone")).distinct()
    j = refs.join(known, "claim_id", "left").join(gone, "claim_id", "left").join(live_versions.select("version_id", F.lit(True).alias("live")), "version_id", "left")
    state = F.when(F.col("version_id").isNull(), "missing").when(F.col("gone"), "superseded").when(F.col("live").isNull(), "retired").otherwise("current")
    return j.select("artifact", "claim_id", state.alias("state"))


def verdicts(checked: DataFrame) -> DataFrame:
    """An artifact is CURRENT if all it refers to is."""
    return checked.groupBy("artifact").agg(F.when(F.bool_and(F.col("state") == "current"), "CURRENT").otherwise("STALE").alias("verdict"), F.count_if(F.col("state") != "current").alias("n_stale"))


def proofs(c: DataFrame) -> DataFrame:
    """One proof a version: its facts as canonical JSON in key order, and their digest."""
    facts = F.array_sort(F.collect_list(F.struct("key", "val")))  # a version holds one claim of each kind
    body = F.concat(F.lit("["), F.array_join(F.transform(facts, lambda x: F.concat(F.lit('{"key":"'), x["key"], F.lit('","val":'), x["val"].cast("string"), F.lit("}"))), ","), F.lit("]"))
    return c.groupBy("version_id").agg(body.alias("body"), F.count("*").alias("n_claims")).select("version_id", "body", "n_claims", F.sha2("body", 256).alias("digest"))


def verify_proofs(given: DataFrame, c: DataFrame, v: DataFrame, live_versions: DataFrame) -> DataFrame:
    """Checks of each given proof, kept apart: integrity, provenance, agreement with the archive, and being in force."""
    now = proofs(c).select("version_id", F.col("digest").alias("_digest"))
    j = given.join(v.select("version_id", F.lit(True).alias("_known")), "version_id", "left").join(now, "version_id", "left").join(live_versions.select("version_id", F.lit(True).alias("_live")), "version_id", "left")
    checks = {"intact": F.sha2("body", 256) == F.col("digest"), "known": F.col("_known").isNotNull(), "agrees": F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False)), "in_force": F.col("_live").isNotNull()}
    reasons = F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()])), ",")
    return j.select("version_id", *[ok.alias(name) for name, ok in checks.items()], reasons.alias("failed"))
