"""State resolution, time travel, changes, audits and lineage over versions and claims.

Every operator takes and gives DataFrames, for all corpora at once. Groups that may be hot (a key, a corpus) are
aggregated with map-side combining and joined back, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable


def instant(x: str | Column) -> Column:
    """A given time; text without a zone means UTC, whatever the session's zone."""
    if not isinstance(x, str):
        return x
    whole = x if len(x) > 10 else f"{x}T00:00:00"
    return F.lit(whole if whole[-1] == "Z" or "+" in whole else f"{whole}Z").cast("timestamp")


def valid(at: str | Column) -> Column:
    """The half-open validity window."""
    at = instant(at)
    return F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(at < F.col("valid_until"), F.lit(True))


def latest_versions(v: DataFrame) -> DataFrame:
    return v.groupBy("corpus_id", "doc_id").agg(F.max("version_number").alias("version_number"), F.max_by("version_id", "version_number").alias("version_id"), F.max_by("event", "version_number").alias("event"))


def resolve(v: DataFrame, c: DataFrame, as_of: str, valid_at: str | None = None) -> DataFrame:
    """Claims observed by as_of with their status at (as_of, valid_at): SUPERSEDED, UNCERTAIN, CONFLICTING or CURRENT."""
    v, c = v.where(F.col("observed_at") <= instant(as_of)), c.where(F.col("observed_at") <= instant(as_of))
    live = latest_versions(v).where("event <> 'DELETED'").select("version_id", F.lit(True).alias("live"))
    retired = c.where("supersedes_id is not null").select(F.col("supersedes_id").alias("claim_id"), F.lit(True).alias("retired")).distinct()
    flagged = c.join(live, "version_id", "left").join(retired, "claim_id", "left")
    status = F.when(F.col("retired"), "SUPERSEDED").when(F.col("live").isNull() | ~valid(valid_at or as_of), "UNCERTAIN").otherwise("CURRENT")
    flagged = flagged.withColumn("status", status).drop("live", "retired")
    mixed = conflict_groups(flagged).select("corpus_id", "key", F.lit(True).alias("mixed"))
    # current claims of a key are of different documents, so unequal values anywhere put all of them in conflict
    out = flagged.join(mixed, ["corpus_id", "key"], "left")
    return out.withColumn("status", F.when(F.col("mixed") & (F.col("status") == "CURRENT"), "CONFLICTING").otherwise(F.col("status"))).drop("mixed")


def conflict_groups(resolved: DataFrame) -> DataFrame:
    """Keys whose current claims hold several values."""
    open_ = resolved.where(F.col("status").isin("CURRENT", "CONFLICTING"))
    return open_.groupBy("corpus_id", "key").agg(F.countDistinct("val").alias("n_values"), F.count("*").alias("n_claims"), F.min("val").alias("least"), F.max("val").alias("most")).where("least <> most").drop("least", "most")


def conflict_pairs(resolved: DataFrame) -> DataFrame:
    """Pairs of conflicting claims, by id inside a key; only keys with a conflict meet."""
    side = resolved.where("status = 'CONFLICTING'").select("corpus_id", "key", "claim_id", "doc_id", "val")
    a, b = side.alias("a"), side.alias("b")
    on = (F.col("a.corpus_id") == F.col("b.corpus_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.claim_id") < F.col("b.claim_id")) & (F.col("a.doc_id") != F.col("b.doc_id")) & (F.col("a.val") != F.col("b.val"))
    return a.join(b, on).select("a.corpus_id", "a.key", F.col("a.claim_id").alias("left_id"), F.col("b.claim_id").alias("right_id"))


def history(resolved: DataFrame, v: DataFrame, as_of: str) -> DataFrame:
    """Historical claims: superseded, or not of a current version."""
    live = latest_versions(v.where(F.col("observed_at") <= instant(as_of))).where("event <> 'DELETED'").select("version_id")
    gone = resolved.join(live, "version_id", "left_anti")
    return resolved.where("status = 'SUPERSEDED'").select("claim_id", "status").union(gone.select("claim_id", "status")).distinct()


def under_prefix(path: str, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in sorted({p.rstrip("/") for p in prefixes}):
        out = out | (F.col(path) == p) | F.col(path).startswith(f"{p}/")
    return out


def changes(v: DataFrame, c: DataFrame) -> DataFrame:
    """Every version with its predecessor's claims and its own, and whether the remembered facts changed."""
    facts = c.groupBy("version_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("key", "val")))).alias("facts"))
    before = facts.select(F.col("version_id").alias("predecessor_id"), F.col("facts").alias("before"))
    j = v.join(before, "predecessor_id", "left").join(facts, "version_id", "left")
    kind = F.when(F.col("event").isin("DELETED", "RESTORED"), "LIFECYCLE").when(F.col("event") == "MODIFIED", "DOCUMENT_MODIFIED").otherwise("NEW")
    return j.select("version_id", "doc_id", "event", kind.alias("kind"), (~F.col("before").eqNullSafe(F.col("facts"))).alias("memory_changed"))


def feed_page(v: DataFrame, after: tuple[str, int], size: int) -> DataFrame:
    """The keyset page after a boundary, in feed order; has_more tells whether another follows."""
    at = instant(after[0])
    rest = v.where((F.col("observed_at") > at) | ((F.col("observed_at") == at) & (F.col("version_id") > after[1])))
    page = rest.orderBy("observed_at", "version_id").limit(size + 1)
    n = F.row_number().over(Window.orderBy("observed_at", "version_id"))
    return page.withColumn("position", n).withColumn("has_more", F.max("position").over(Window.partitionBy()) > size).where(F.col("position") <= size).select("position", "version_id", "event", "has_more")


def snapshot_diff(v: DataFrame, c: DataFrame, before: str, after: str) -> DataFrame:
    """Keys of each document ADDED, REMOVED or MODIFIED between the live claims of two instants."""

    def live(t: str, name: str) -> DataFrame:
        seen = latest_versions(v.where(F.col("observed_at") <= instant(t))).where("event <> 'DELETED'").select("version_id")
        return c.join(seen, "version_id", "left_semi").select("doc_id", "key", F.col("val").alias(name))

    j = live(before, "old").join(live(after, "new"), ["doc_id", "key"], "full_outer")
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "MODIFIED")
    return j.withColumn("change", change).where("change is not null").select("doc_id", "key", "change", "old", "new")


def drift(v: DataFrame, c: DataFrame, since: str) -> DataFrame:
    """Claims new since an instant (same key and text not known before), superseded since, retired by deletion since."""
    t = instant(since)
    old, fresh = c.where(F.col("observed_at") <= t), c.where(F.col("observed_at") > t)
    norm = F.lower(F.trim(F.regexp_replace("claim", r"\s+", " "))).alias("norm")
    new = fresh.select("claim_id", "corpus_id", "key", norm).join(old.select("corpus_id", "key", norm).distinct(), ["corpus_id", "key", "norm"], "left_anti").select("claim_id", F.lit("new").alias("drift"))
    superseded = old.join(fresh.select(F.col("supersedes_id").alias("claim_id")), "claim_id", "left_semi").select("claim_id", F.lit("superseded").alias("drift"))
    gone = v.where((F.col("event") == "DELETED") & (F.col("observed_at") > t)).select(F.col("predecessor_id").alias("version_id")).distinct()
    retired = c.join(gone, "version_id", "left_semi").select("claim_id", F.lit("retired").alias("drift"))
    return new.union(superseded).union(retired)


def in_force(c: DataFrame, valid_at: str, as_of: str) -> DataFrame:
    """Per (corpus, key) the claim in force: valid at the instant first, then the latest observed."""
    seen = c.where(F.col("observed_at") <= instant(as_of))
    rank = F.struct(valid(valid_at).cast("int").alias("a"), F.col("observed_at").alias("b"), F.col("claim_id").alias("c"))
    return seen.groupBy("corpus_id", "key").agg(F.max_by(F.struct("claim_id", "val"), rank).alias("x"), F.max(valid(valid_at)).alias("inside")).select("corpus_id", "key", "x.claim_id", "x.val", "inside")


def audit_predecessors(v: DataFrame) -> DataFrame:
    """Versions whose number, time or event does not follow from their predecessor."""
    w = Window.partitionBy("doc_id").orderBy("version_number")
    p = v.withColumn("p", F.lag(F.struct("version_id", "version_number", "observed_at", "event")).over(w))
    legal = F.when(F.col("p").isNull(), (F.col("event") == "NEW") & F.col("predecessor_id").isNull()).otherwise((F.col("p.version_id") == F.col("predecessor_id")) & (F.col("p.version_number") == F.col("version_number") - 1) & (F.col("p.observed_at") < F.col("observed_at")) & (F.when(F.col("p.event") == "DELETED", F.col("event") == "RESTORED").otherwise(F.col("event").isin("MODIFIED", "DELETED"))))
    return p.where(~legal).select("version_id", "event")


def audit_evidence(e: DataFrame) -> DataFrame:
    """Evidence whose offsets do not cut its quote out of its chunk."""
    ok = (F.expr("substring(chunk, start_offset + 1, end_offset - start_offset)") == F.col("quote")) & (F.col("end_offset") - F.col("start_offset") == F.length("quote"))
    return e.where(~ok).select("claim_id", "start_offset", "end_offset")


def audit_edges(c: DataFrame) -> DataFrame:
    """Edges whose target is of another corpus or key, or not strictly earlier."""
    t = c.select(F.col("claim_id").alias("supersedes_id"), F.col("corpus_id").alias("t_corpus"), F.col("key").alias("t_key"), F.col("observed_at").alias("t_at"))
    return c.where("supersedes_id is not null").join(t, "supersedes_id", "left").where("t_corpus is null or t_corpus <> corpus_id or t_key <> key or t_at >= observed_at").select("claim_id", "supersedes_id")


def lineage(c: DataFrame) -> DataFrame:
    """Each claim's first ancestor along supersedes_id: pointer doubling, O(log depth) rounds over the claims with an edge.

    An edge to a claim that is not in the table ends the chain there. Claims on a cycle, or behind one, have no first
    ancestor: their chain_id is null.
    """
    known = c.select(F.col("claim_id").alias("supersedes_id"))
    edges = durable(c.where("supersedes_id is not null").join(known, "supersedes_id", "left_semi").select("claim_id", F.col("supersedes_id").alias("up")))
    n, rounds, p = edges.count(), 0, edges.withColumn("done", F.lit(False))
    while n and not p.where("not done").isEmpty() and 1 << rounds <= 2 * n:
        q = p.select(F.col("claim_id").alias("up"), F.col("up").alias("higher"), F.col("done").alias("there"))
        p = durable(p.join(q, "up", "left").select("claim_id", F.coalesce("higher", "up").alias("up"), (F.col("done") | F.col("higher").isNull() | F.coalesce("there", F.lit(False))).alias("done")))
        rounds += 1
    chained = p.select("claim_id", F.when(F.col("done"), F.col("up")).alias("chain_id"))
    return chained.union(c.select("claim_id").join(edges, "claim_id", "left_anti").select("claim_id", "claim_id"))


def conflict_sides(resolved: DataFrame) -> DataFrame:
    """Each conflicting claim with its side: the first claim of the key that says the same, and how many sides there are.

    The claims of a key conflict with all of other values, so sides tell the whole graph without its pairs.
    """
    open_ = resolved.where("status = 'CONFLICTING'")
    sides = open_.groupBy("corpus_id", "key", "val").agg(F.min("claim_id").alias("side"))
    n = sides.groupBy("corpus_id", "key").agg(F.count("*").alias("n_sides"))
    return open_.select("corpus_id", "key", "val", "claim_id").join(sides, ["corpus_id", "key", "val"]).join(n, ["corpus_id", "key"]).select("claim_id", "side", "n_sides")
