"""Gates before and after an answer: requests, scopes, withholding, vectors, targets of supersession, decisions.

Per-request groups are windows or aggregates by request; keys that may be hot are aggregated and joined back.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The selectors that each operation takes besides corpus and query, and the one it requires.
ALLOWED = {
    "current": ("path", "path_prefix", "valid_at", "include_states"),
    "as-of": ("path", "as_of", "valid_at"),
    "history": ("path", "path_prefix", "as_of", "valid_at"),
    "changes": ("path", "as_of", "valid_at"),
    "evidence": ("claim_id", "as_of", "valid_at"),
    "snapshot": ("as_of",),
    "replay": ("snapshot_id", "path"),
    "pack": ("path", "path_prefix", "as_of", "valid_at", "snapshot_id", "budget", "include_states"),
    "query": ("path", "path_prefix", "as_of", "valid_at", "snapshot_id", "budget", "intent", "include_receipt"),
}
REQUIRED = {"as-of": "as_of", "evidence": "claim_id", "replay": "snapshot_id"}
SELECTORS = ("path", "path_prefix", "as_of", "valid_at", "snapshot_id", "claim_id", "include_states")
WITHHELD = ("draft", "rejected", "superseded")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds, else null."""
    return F.coalesce(*[F.when(holds, F.lit(reason)) for holds, reason in rules])


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds reason: null where the request is accepted. Null selectors are unset; include_states is an array."""
    op = F.col("operation")
    missing = reduce(lambda a, b: a | b, [(op == o) & F.col(c).isNull() for o, c in REQUIRED.items()])
    unsupported = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & ~op.isin(*[o for o, allowed in ALLOWED.items() if c in allowed]) for c in SELECTORS])
    unknown_state = F.coalesce(F.size(F.array_except("include_states", F.array(*map(F.lit, WITHHELD)))) > 0, F.lit(False))
    return requests.withColumn("reason", first_reason(
        (op.isNull() | ~op.isin(*ALLOWED), "invalid_operation"),
        (missing, "selector_required"),
        (unsupported, "selector_not_supported"),
        (unknown_state, "invalid_state"),
        (F.col("path").isNotNull() & F.col("path_prefix").isNotNull(), "path_conflict"),
        (F.trim("path_prefix") == "", "empty_path_prefix"),
        (F.col("snapshot_id").isNotNull() & (F.col("as_of").isNotNull() | F.col("valid_at").isNotNull()), "snapshot_fixes_cutoffs"),
        ((op == "snapshot") & (F.coalesce("query", F.lit("")) != ""), "snapshot_takes_no_query"),
    ))


def scope_conflicts(asked: DataFrame, conflicting: DataFrame, in_scope: Column) -> DataFrame:
    """The sides of each conflict inside a request's scope: kept where two or more are left, promoted where one is.

    asked: request_id, prefixes (a stated set of requests, at most some thousands); conflicting: claim_id, corpus_id, key, path.
    in_scope is over the columns of both.
    """
    sides = conflicting.join(asked, in_scope).select("request_id", "corpus_id", "key", "claim_id").distinct()
    n = sides.groupBy("request_id", "corpus_id", "key").agg(F.count("*").alias("n_sides"))
    return sides.join(n, ["request_id", "corpus_id", "key"]).select("request_id", "claim_id", F.when(F.col("n_sides") >= 2, "kept").otherwise("promoted").alias("outcome"))


def withhold(claims: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """claim_id, corpus_id, key, status, info_state -> outcome: withheld, kept, or promoted out of a conflict left with one side."""
    hidden = F.col("info_state").isin(*[s for s in WITHHELD if s not in include])
    shown = claims.where(~hidden | F.col("info_state").isNull())
    left = shown.where("status = 'CONFLICTING'").groupBy("corpus_id", "key").agg((F.count("*") == 1).alias("_alone"))
    j = claims.join(left, ["corpus_id", "key"], "left")
    outcome = F.when(hidden, "withheld").when((F.col("status") == "CONFLICTING") & F.col("_alone"), "promoted").otherwise("kept")
    return j.withColumn("outcome", outcome).drop("_alone")


def decodable(vector: str, dimension: int) -> Column:
    """Not null, of the right dimension, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimension) & ~bad, F.lit(False))


def subject_of(claim: Column) -> Column:
    """What stands before the first colon, else the first five words, in lower case; null for none."""
    text = F.trim(claim)
    named = F.when(text.contains(":"), F.trim(F.substring_index(text, ":", 1))).otherwise(F.array_join(F.slice(F.split(text, r"\s+"), 1, 5), " "))
    return F.when(named != "", F.lower(named))


def pair_targets(authored: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target of a group is replaced by.

    authored: group_id, key, claim, with one row per key; targets: group_id, target_id, key, claim. By key first (the first
    target of a key takes it), then by a subject that exactly one remaining key of the group has; the first target of that
    subject takes it, and none is left for another, so one round is the fixpoint. A group that then has both targets and
    keys left is refused as a whole. outcome: key, subject, unpaired, refused; key is null but for the first two.
    """
    order = Window.partitionBy("group_id", "key").orderBy("target_id")
    t = targets.select("group_id", "target_id", "key", subject_of(F.col("claim")).alias("subject"), F.row_number().over(order).alias("_nth"))
    by_key = t.where("_nth = 1").join(authored.select("group_id", "key"), ["group_id", "key"]).select("group_id", "target_id", F.col("key").alias("taken"), F.lit("key").alias("how"))
    keys = authored.join(by_key.select("group_id", F.col("taken").alias("key")), ["group_id", "key"], "left_anti").select("group_id", "key", subject_of(F.col("claim")).alias("subject"))
    rest = t.join(by_key.select("group_id", "target_id"), ["group_id", "target_id"], "left_anti")
    single = keys.where("subject is not null").groupBy("group_id", "subject").agg(F.min("key").alias("taken"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    first = rest.where("subject is not null").groupBy("group_id", "subject").agg(F.min("target_id").alias("target_id"))
    by_subject = first.join(single, ["group_id", "subject"]).select("group_id", "target_id", "taken", F.lit("subject").alias("how"))
    paired = by_key.unionByName(by_subject)
    n_keys = authored.groupBy("group_id").agg(F.count("*").alias("_keys"))
    n_targets = targets.groupBy("group_id").agg(F.count("*").alias("_targets"))
    n_paired = paired.groupBy("group_id").agg(F.count("*").alias("_paired"))
    sizes = n_targets.join(n_keys, "group_id", "left").join(n_paired, "group_id", "left").na.fill(0, ["_keys", "_paired"])
    refused = sizes.select("group_id", ((F.col("_keys") > F.col("_paired")) & (F.col("_targets") > F.col("_paired"))).alias("_refused"))
    j = targets.select("group_id", "target_id").join(paired, ["group_id", "target_id"], "left").join(refused, "group_id")
    outcome = F.when(F.col("_refused"), "refused").otherwise(F.coalesce("how", F.lit("unpaired")))
    return j.select("group_id", "target_id", F.when(~F.col("_refused"), F.col("taken")).alias("key"), outcome.alias("outcome"))


def explicit_targets(requests: DataFrame, authored: DataFrame, active: DataFrame) -> DataFrame:
    """Which live claim of another document a version's claim retires, or why none.

    requests: request_id, corpus_id, doc_id, supersedes (a claim id or null), topic_key (or null); authored: request_id, key;
    active: claim_id, corpus_id, doc_id, key. A named claim stands over a topic key.
    """
    keys = authored.groupBy("request_id").agg(F.count_distinct("key").alias("_keys"), F.min("key").alias("_only"))
    r = requests.join(keys, "request_id", "left")
    own = authored.select("request_id", F.col("key").alias("topic_key"), F.lit(True).alias("_authored")).distinct()
    r = r.join(own, ["request_id", "topic_key"], "left")
    named = active.select(F.col("claim_id").alias("supersedes"), "corpus_id", F.col("key").alias("_key"), F.col("doc_id").alias("_doc"))
    r = r.join(named, ["supersedes", "corpus_id"], "left")
    r = r.withColumn("_found", F.col("_key").isNotNull() & (F.col("_doc") != F.col("doc_id")))
    r = r.join(authored.select("request_id", F.col("key").alias("_key"), F.lit(True).alias("_same")).distinct(), ["request_id", "_key"], "left")
    # the live claims of a topic, and those of the asking document, which do not count
    total = active.groupBy("corpus_id", F.col("key").alias("topic_key")).agg(F.count("*").alias("_all"))
    mine = active.groupBy("corpus_id", "doc_id", F.col("key").alias("topic_key")).agg(F.count("*").alias("_own"))
    r = r.join(total, ["corpus_id", "topic_key"], "left").join(mine, ["corpus_id", "doc_id", "topic_key"], "left").na.fill(0, ["_all", "_own"])
    r = r.withColumn("_others", F.col("_all") - F.col("_own"))
    sole = r.where("_others = 1").select("request_id", "corpus_id", "topic_key", "doc_id").join(
        active.select("corpus_id", F.col("key").alias("topic_key"), F.col("doc_id").alias("_o"), F.col("claim_id").alias("_sole")), ["corpus_id", "topic_key"]
    ).where("_o <> doc_id").select("request_id", "_sole")
    r = r.join(sole, "request_id", "left")
    has_topic, has_name = F.col("topic_key").isNotNull(), F.col("supersedes").isNotNull()
    outcome = (
        F.when(has_topic & F.col("_authored").isNull(), "topic_key_not_authored")
        .when(has_name & ~F.col("_found"), "target_not_active").when(has_name & (F.col("_same") | (F.col("_keys") == 1)), "explicit_claim_id").when(has_name, "ambiguous_authored")
        .when(has_topic & (F.col("_others") == 0), "no_target").when(has_topic & (F.col("_others") > 1), "topic_ambiguous").when(has_topic, "topic_key").otherwise("none")
    )
    r = r.withColumn("outcome", outcome)
    target = F.when(F.col("outcome") == "explicit_claim_id", F.col("supersedes")).when(F.col("outcome") == "topic_key", F.col("_sole"))
    key = F.when(F.col("outcome") == "explicit_claim_id", F.when(F.col("_same"), F.col("_key")).otherwise(F.col("_only"))).when(F.col("outcome") == "topic_key", F.col("topic_key"))
    return r.select("request_id", "outcome", target.alias("target_id"), key.alias("key"))


def clamp(x: Column) -> Column:
    """A score inside [0, 1], to six places."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6)


def decide(candidates: DataFrame, threshold: float = 0.30) -> DataFrame:
    """question_id, item_id, relevance, overlap -> the pick of each question or none, with its confidences.

    The best by relevance, overlap and id; it abstains where the best, or its blend with the margin, is under the threshold.
    """
    top = F.slice(F.sort_array(F.collect_list(F.struct("relevance", "overlap", "item_id")), asc=False), 1, 2)
    # two rows at most stay: ranked first, so no group is gathered
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("relevance"), F.desc("overlap"), F.desc("item_id")))
    best = candidates.withColumn("_r", rank).where("_r <= 2").groupBy("question_id").agg(top.alias("t"))
    first, second = F.col("t")[0], F.coalesce(F.get(F.col("t"), F.lit(1))["relevance"], F.lit(0.0))
    blend = clamp(first["relevance"] * 0.7 + (first["relevance"] - second) * 0.3)
    abstained = first["relevance"] < threshold
    return best.select("question_id", F.when(~abstained, first["item_id"]).alias("selected_id"), blend.alias("confidence"), (abstained | (blend < threshold)).alias("abstained"))


def shortlist(scored: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The n best items of each group by score, then id."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def rerank(fetched: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """query_id, item_id (over-fetched) with scores from elsewhere (query_id, item_id, score) -> the k best by those."""
    return shortlist(fetched.select("query_id", "item_id").join(scores, ["query_id", "item_id"]), "query_id", "item_id", k)


def compare_strategies(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """Means per strategy: recall and MRR over queries with an answer, precision over all, to six places.

    ranked: strategy, query_id, item_id, rank; relevant: query_id, item_id; queries: query_id, negative; with total (query_id,
    n) relevant may leave out what is not ranked. A negative query has no
    relevant item, so whatever it returns lowers the precision; one that returns nothing scores a precision of 0.
    """
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").join(queries, "query_id")
    hit = F.when(F.col("negative"), 0).otherwise(F.coalesce("hit", F.lit(0)))
    per = hits.groupBy("strategy", "query_id").agg(F.sum(hit).alias("h"), F.count("*").alias("r"), F.min(F.when(hit == 1, F.col("rank"))).alias("first"))
    size = relevant.groupBy("query_id").agg(F.count("*").alias("n")) if total is None else total
    n = queries.agg(F.count("*").alias("all"), F.count_if(~F.col("negative")).alias("positive")).first()
    per = per.join(size, "query_id", "left").join(queries, "query_id")
    recall = F.sum(F.when(~F.col("negative"), F.col("h") / F.greatest("n", F.lit(1))))
    mean = per.groupBy("strategy").agg(recall.alias("s_recall"), F.sum(F.when(~F.col("negative"), F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("s_rr"), F.sum(F.col("h") / F.col("r")).alias("s_precision"))
    mean = mean.withColumns({"recall": F.col("s_recall") / n["positive"], "mrr": F.col("s_rr") / n["positive"], "precision": F.col("s_precision") / n["all"]})
    return mean.select("strategy", *[F.round(m, 6).alias(m) for m in ("recall", "mrr", "precision")])


def heldout_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked: question_id, key, rank; gold: question_id, key. One row: r1, r5, r10, mrr, ndcg5 and the recall ceiling.

    ndcg5 is divided by the ideal of five items although a question has one gold key.
    """
    at = gold.join(ranked, ["question_id", "key"], "left")
    ideal = F.lit(sum(1 / math.log2(i + 1) for i in range(1, 6)))
    share = lambda n: F.avg(F.coalesce((F.col("rank") <= n).cast("double"), F.lit(0.0)))
    gain = F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    out = {"r1": share(1), "r5": share(5), "r10": share(10), "mrr": F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), "ndcg5": F.avg(gain) / ideal, "ceiling": F.avg(F.col("rank").isNotNull().cast("double"))}
    return at.agg(F.count("*").alias("n_questions"), *[F.round(x, 6).alias(name) for name, x in out.items()])


def equal_packs(left: DataFrame, right: DataFrame) -> DataFrame:
    """pack_id, item_id, body, at of two runs -> equal: the same items and bodies, and times in the same order, not of the same value."""

    def normal(p: DataFrame) -> DataFrame:
        return p.withColumn("at", F.dense_rank().over(Window.partitionBy("pack_id").orderBy("at")))

    a = normal(left).select("pack_id", "item_id", F.struct("body", "at").alias("a"))
    b = normal(right).select("pack_id", "item_id", F.struct("body", "at").alias("b"))
    return a.join(b, ["pack_id", "item_id"], "full_outer").groupBy("pack_id").agg(F.min(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))


def context_strategy(requests: DataFrame, archived: DataFrame, relevant: DataFrame) -> DataFrame:
    """request_id, corpus_id -> authoritative where the corpus has an archive (without retrieval if it has nothing relevant), else retrieval_only."""
    j = requests.join(archived.select("corpus_id", F.lit(True).alias("_a")).distinct(), "corpus_id", "left").join(relevant.select("request_id", F.lit(True).alias("_r")).distinct(), "request_id", "left")
    return j.select("request_id", F.when(F.col("_a").isNull(), "retrieval_only").when(F.col("_r"), "authoritative").otherwise("authoritative_no_retrieval").alias("strategy"))


def ordinals(rows: DataFrame, group: tuple[str, ...], position: str) -> DataFrame:
    """Adds ordinal: the place of each row in its group, from 0."""
    return rows.select(*[c for c in rows.columns if c not in group or c == group[0]], (F.row_number().over(Window.partitionBy(*group).orderBy(position)) - 1).alias("ordinal"))
