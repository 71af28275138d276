"""Joins, rankings and counts over resolved claims, requests and stored artifacts, for all corpora at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import overlaps
from palimpsest.operators.matching import claim_words, content_terms
from palimpsest.operators.relevance import small


def latest_of(docs: DataFrame, v: DataFrame, key: str) -> DataFrame:
    """docs with the number, event and time of their latest version; documents without one stay, with nulls."""
    last = v.groupBy(F.col("doc_id").alias("_d")).agg(F.max_by(F.struct("version_number", "event", "version_id"), "version_number").alias("_v"))
    return docs.join(last, F.col(key) == F.col("_d"), "left").select(*docs.columns, "_v.version_number", "_v.event", "_v.version_id")


def replaced(c: DataFrame) -> DataFrame:
    """Claims that replaced another document's, with what these said."""
    target = c.select(F.col("claim_id").alias("supersedes_id"), F.col("val").alias("before"), F.col("doc_id").alias("before_doc"))
    return c.where("supersedes_id is not null").join(target, "supersedes_id").where("before_doc <> doc_id").select("claim_id", "supersedes_id", "before", "val")


def log_verdicts(calls: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every feedback row with the status of the last call of its query; unknown where there was none."""
    last = calls.groupBy("query_id").agg(F.max_by("match_status", "at").alias("status"))
    return feedback.join(last, "query_id", "left").select("feedback_id", "verdict", F.coalesce("status", F.lit("unknown")).alias("status"))


def decision_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs' (question_id, right) -> counts of kept, fixed, broken and still wrong."""
    j = before.withColumnRenamed("right", "a").join(after.withColumnRenamed("right", "b"), "question_id")
    change = F.when(F.col("a") & F.col("b"), "kept").when(~F.col("a") & F.col("b"), "fixed").when(F.col("a") & ~F.col("b"), "broken").otherwise("still wrong")
    return j.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def paired_differences(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """(strategy, query_no, value) of two runs -> mean difference over the queries that both hold."""
    j = run.join(baseline.withColumnRenamed("value", "base"), ["strategy", "query_no"])
    return j.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") - F.col("base")), 6).alias("mean_difference"), F.count_if(F.col("value") > F.col("base")).alias("n_better"))


def valid_at_questions(questions: DataFrame, c: DataFrame) -> DataFrame:
    """(question_id, doc_id, at) -> how many of the document's claims were observed by then and valid then.

    Questions and windows meet by document and day of observation at most; the range is checked on what meets.
    """
    on = (F.col("q.doc_id") == F.col("c.doc_id")) & (F.col("c.observed_at") <= F.col("q.at")) & (F.col("c.valid_from") <= F.col("q.at")) & (F.col("c.valid_until").isNull() | (F.col("q.at") < F.col("c.valid_until")))
    hits = questions.alias("q").join(c.alias("c"), on).groupBy("q.question_id").agg(F.count("*").alias("n_valid"))
    return questions.select("question_id").join(hits, "question_id", "left").select("question_id", F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def resolve_references(refs: DataFrame, c: DataFrame) -> DataFrame:
    """(ref_id, corpus_id, kind, ref) -> live claims named by key, id prefix or path: resolved, ambiguous or unresolved."""
    by = [("key", F.col("key")), ("id", F.col("claim_id")), ("path", F.lower("path"))]
    names = c.select("corpus_id", "claim_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("ref")) for k, x in by])).alias("x")).select("corpus_id", "claim_id", "x.*")
    # ids are cut to the lengths that a corpus was asked for, of which there are no more than an id has characters
    asked = refs.where("kind = 'prefix'").groupBy("corpus_id").agg(F.collect_set(F.length("ref")).alias("lengths"))
    prefixes = names.where("kind = 'id'").join(asked, "corpus_id").select("corpus_id", "claim_id", F.lit("prefix").alias("kind"), F.col("ref").alias("whole"), F.explode("lengths").alias("n")).where(F.length("whole") >= F.col("n")).withColumn("ref", F.col("whole").substr(F.lit(1), F.col("n")))
    wanted = refs.withColumn("ref", F.when(F.col("kind") == "path", F.lower("ref")).otherwise(F.col("ref")))
    # names are counted before references meet them: what many claims are called is one row, however many references ask for it
    named = names.union(prefixes.select(*names.columns)).groupBy("corpus_id", "kind", "ref").agg(F.count("*").alias("n"), F.min("claim_id").alias("claim_id"))
    hits = wanted.join(named, ["corpus_id", "kind", "ref"], "left").groupBy("ref_id", "kind").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("claim_id").alias("claim_id"))
    outcome = F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return hits.select("ref_id", "kind", "n", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("claim_id")).alias("claim_id"))


def request_overlaps(requests: DataFrame, c: DataFrame, common: int = overlaps.COMMON) -> overlaps.Overlaps:
    """Requests against the sentences of their corpus' claims, by content words."""
    asked = requests.select("request_id", "corpus_id", content_terms(F.col("text")).alias("terms")).where("size(terms) > 0")
    return overlaps.overlaps(asked, claim_words(c).withColumnRenamed("claim_id", "item_id"), "said", common)


def overlap_keys(x: overlaps.Overlaps, c: DataFrame, floor: float, band: float) -> DataFrame:
    """best_keys over all claims that reach the floor: request_id, corpus_id, key, score."""
    score = lambda name: F.round(name, 6)
    keyed = overlaps.best(x, floor, score("score") >= F.lit(band) * score("top") - 1e-9, c.select(F.col("claim_id").alias("item_id"), F.col("key").alias("group")))
    return keyed.join(x.asked.select("request_id", "corpus_id"), "request_id").select("request_id", "corpus_id", F.col("group").alias("key"), score("score").alias("score"))


def overlap_first(x: overlaps.Overlaps, floor: float, rows: DataFrame, order: list[Column], k: int, group: str | None = None) -> DataFrame:
    """rows (claim_id, ...) with request_id and score: pairs among which are the k first of each request by score, then order."""
    found = overlaps.first(x, floor, rows.withColumnRenamed("claim_id", "item_id"), [F.col("item_id") if o == "claim_id" else o for o in order], k, group)
    return found.select("request_id", F.col("item_id").alias("claim_id"), F.round("score", 6).alias("score")).join(rows, "claim_id")


def best_keys(pairs: DataFrame, c: DataFrame, band: float) -> DataFrame:
    """Keys of each request with at least `band` of its best key's score; a key scores what its best claim does."""
    keyed = pairs.join(c.select("claim_id", "corpus_id", "key"), "claim_id").groupBy("request_id", "corpus_id", "key").agg(F.max("score").alias("score"))
    top = F.max("score").over(Window.partitionBy("request_id"))
    return keyed.withColumn("_top", top).where(F.col("score") >= F.lit(band) * F.col("_top") - 1e-9).drop("_top")


def boilerplate(c: DataFrame, least: int = 12, share: float = 0.065) -> DataFrame:
    """Terms of each corpus in at least max(least, share of its claims) claims, and whether all claims hold them."""
    n = c.groupBy("corpus_id").agg(F.count("*").alias("n_claims"))
    df = claim_words(c).select("corpus_id", F.explode("said").alias("term")).groupBy("corpus_id", "term").agg(F.count("*").alias("df"))
    kept = df.join(n, "corpus_id").where(F.col("df") >= F.greatest(F.lit(least), F.floor(F.col("n_claims") * share)))
    return kept.select("corpus_id", "term", "df", (F.col("df") == F.col("n_claims")).alias("everywhere"))


def near_tie_order(keys: DataFrame, c: DataFrame, band: float = 0.10) -> DataFrame:
    """(request_id, corpus_id, key, score) in order; keys within the band of the best stand unscoped before scoped, then by score.

    A key is scoped where all its claims in the request's corpus have a validity window.
    """
    scoped = c.groupBy("corpus_id", "key").agg(F.bool_and(F.col("valid_from").isNotNull() | F.col("valid_until").isNotNull()).alias("scoped"))
    j = keys.join(scoped, ["corpus_id", "key"], "left").withColumn("_close", F.max("score").over(Window.partitionBy("request_id")) - F.col("score") < band)
    close = F.coalesce("scoped", F.lit(False)) & F.col("_close")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("_close"), close, F.desc("score"), "key"))
    return j.select("request_id", "key", place.alias("position"))


BLOCK, BLOCKS, TASK = 4_096, 1_024, 2_000_000  # keys of a list that a request takes at once, most of them to broadcast, rows of a task


def overlap_tie_order(x: overlaps.Overlaps, c: DataFrame, floor: float, least: float, band: float = 0.10) -> DataFrame:
    """near_tie_order of overlap_keys(x, c, floor, least), of which no row is shuffled or put in order.

    Requests with the same common terms, number of terms and best score list the same keys, but for those of the claims that
    they share a rare term with. Such a list is put in order once and cut into blocks. A request takes it in segments, between
    the places where its own keys come in and where these stood before.
    """
    kind, list_ = ["corpus_id", "wanted"], ["corpus_id", "wanted", "n", "top"]
    keys = c.select(F.col("claim_id").alias("item_id"), "key")
    near = durable(x.near.join(keys, "item_id").groupBy("request_id", "key").agg(F.max("shared").alias("m")))
    asked = x.asked.join(small(x.kinds.groupBy(*kind).agg(F.max("plain").alias("_a"))), kind, "left").join(near.groupBy("request_id").agg(F.max("m").alias("_b")), "request_id", "left")
    asked = durable(asked.withColumn("top", F.greatest("_a", "_b")).where(F.col("top") / F.col("n") >= floor).select("request_id", *list_))
    lists = durable(asked.select(*list_).distinct().withColumn("list", F.monotonically_increasing_id()))
    asked = asked.join(small(lists), list_)
    members = durable(x.items.join(keys, "item_id").select("corpus_id", "held", "key").distinct().join(small(x.kinds), ["corpus_id", "held"]).groupBy(*kind, "key").agg(F.max("plain").alias("m")))
    scoped = c.groupBy("corpus_id", "key").agg(F.bool_and(F.col("valid_from").isNotNull() | F.col("valid_until").isNotNull()).alias("scoped"))

    def placed(rows: DataFrame) -> DataFrame:
        """What of (corpus_id, key, n, top, m, ...) reaches the floor and the share of the best, with its place in order."""
        score, top = F.round(F.col("m") / F.col("n"), 6), F.round(F.col("top") / F.col("n"), 6)
        close = top - score < band
        order = F.struct((~close).alias("a"), (F.coalesce("scoped", F.lit(False)) & close).alias("b"), (-score).alias("c"), F.col("key").alias("d"))
        kept = rows.where((F.col("m") / F.col("n") >= floor) & (score >= F.lit(least) * top - 1e-9))
        return kept.join(scoped, ["corpus_id", "key"], "left").withColumn("o", order)

    base = placed(members.join(small(lists), kind)).select("list", "key", "m", "o")
    own = near.join(asked, "request_id").join(members.select(*kind, "key", F.col("m").alias("_m")), [*kind, "key"], "left").where("_m is null or m > _m")
    own = durable(placed(own.select("request_id", "list", "corpus_id", "key", "n", "top", "m")).select("request_id", "list", "key", "m", "o"))
    before = F.count(F.when(F.col("_base"), 1)).over(Window.partitionBy("list").orderBy("o", "_base").rowsBetween(Window.unboundedPreceding, 0))
    spots = durable(base.withColumn("_base", F.lit(True)).union(own.select("list", "key", "m", "o").distinct().withColumn("_base", F.lit(False))).withColumn("at", before))
    base = spots.where("_base").select("list", "key", (F.col("at") - 1).alias("at"))
    own = own.join(spots.where("not _base").select("list", "key", "m", "at"), ["list", "key", "m"]).join(base.select("list", "key", F.col("at").alias("was")), ["list", "key"], "left")
    # what happens to a request on its way down the list, at a place: 0 goes on, with one place less after an own key's old place, 1 own key comes in, 2 its old place is left out
    step = lambda at, what, plus: F.struct(at.alias("at"), F.lit(what).alias("what"), F.lit(plus).alias("plus"))
    was = F.when(F.col("was").isNotNull(), F.array(step(F.col("was"), 2, 0), step(F.col("was") + 1, 0, -1)))
    steps = own.select("request_id", "list", "key", "o", F.explode(F.concat(F.array(step(F.col("at"), 1, 1)), F.coalesce(was, F.array().cast("array<struct<at:bigint,what:int,plus:int>>")))).alias("x"))
    steps = steps.select("request_id", "list", F.when(F.col("x.what") == 1, F.col("key")).alias("key"), F.when(F.col("x.what") == 1, F.col("o")).alias("o"), "x.*")
    start = asked.select("request_id", "list", F.lit(None).cast("string").alias("key"), F.lit(None).cast(steps.schema["o"].dataType).alias("o"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("what"), F.lit(0).alias("plus"))
    w = Window.partitionBy("request_id").orderBy("at", "what", "o")
    sizes = base.groupBy("list").agg(F.count("*").alias("size"))
    steps = steps.union(start).join(small(sizes), "list", "left").withColumns({"plus": F.sum("plus").over(w.rowsBetween(Window.unboundedPreceding, 0)), "to": F.coalesce(F.lead("at").over(w), "size", F.lit(0))})
    steps = durable(steps.select("request_id", "list", "key", "at", "to", "what", "plus"))
    segments = steps.where("what < 2 and to > at")
    n = segments.agg(F.sum(F.col("to") - F.col("at"))).first()[0] or 0
    block = F.expr(f"at div {BLOCK}").alias("block")
    blocks = base.groupBy("list", block).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda y: y["key"]).alias("keys"))
    part = segments.withColumn("block", F.explode(F.expr(f"sequence(at div {BLOCK}, (to - 1) div {BLOCK})"))).withColumns({"at": F.greatest("at", F.col("block") * BLOCK), "to": F.least("to", (F.col("block") + 1) * BLOCK)})
    part = part.select("request_id", "list", "block", "at", "to", "plus").repartition(n // TASK + 1).join(small(blocks, BLOCKS), ["list", "block"])
    taken = F.slice("keys", (F.col("at") - F.col("block") * BLOCK + 1).cast("int"), (F.col("to") - F.col("at")).cast("int"))
    rest = part.select("request_id", (F.col("at") + F.col("plus") + 1).cast("int").alias("first"), F.posexplode(taken).alias("i", "key")).select("request_id", "key", (F.col("first") + F.col("i")).alias("position"))
    return steps.where("what = 1").select("request_id", "key", (F.col("at") + F.col("plus")).cast("int").alias("position")).union(rest)


def distinct_top(ranked: DataFrame, by: str, group: str, order: list[Column], k: int) -> DataFrame:
    """The first of each group in order, then the k first groups, renumbered."""
    first = F.row_number().over(Window.partitionBy(by, group).orderBy(*order))
    once = ranked.withColumn("_first", first).where("_first = 1").drop("_first")
    return once.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("position") <= k)


def selection(keys: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claims of each request's keys that are current or conflicting, what they replaced, and whether their key conflicts.

    The current claims of a key all conflict or none does, so the closure over conflicts is a join by key.
    """
    live = resolved.where("status in ('CURRENT', 'CONFLICTING')")
    chosen = keys.select("request_id", "corpus_id", "key").join(live, ["corpus_id", "key"])
    own = chosen.select("request_id", "claim_id", F.lower("status").alias("part"))
    before = chosen.where("supersedes_id is not null").select("request_id", F.col("supersedes_id").alias("claim_id"), F.lit("replaced").alias("part"))
    return own.union(before.join(resolved.select("claim_id"), "claim_id", "left_semi").select("request_id", "claim_id", "part")).distinct()


SECTIONS = ("CONFLICTING", "CURRENT", "SUPERSEDED", "UNCERTAIN")  # fixed order of a context's sections


def context_sections(resolved: DataFrame, by: str, budget: int) -> DataFrame:
    """Claims of each document by section, up to the first that does not fit the budget; a section's title costs as well."""
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("status"))
    first = F.row_number().over(Window.partitionBy(by, "status").orderBy(F.desc("observed_at"), "claim_id")) == 1
    sized = resolved.withColumn("_o", order).withColumn("_size", F.length("claim") + F.when(first, F.length("status")).otherwise(0))
    used = F.sum("_size").over(Window.partitionBy(by).orderBy("_o", F.desc("observed_at"), "claim_id").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("used", used.cast("long")).where(F.col("used") <= budget).select(by, "status", "claim_id", "used")


def pack_status(resolved: DataFrame, by: str) -> DataFrame:
    """What kind of answer each pack is: CONFLICTING, RESOLVED or UNCERTAIN, with its number of keys."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    g = resolved.groupBy(by).agg(n("CONFLICTING").alias("conflicts"), n("CURRENT").alias("current"), n("SUPERSEDED").alias("historical"), n("UNCERTAIN").alias("uncertain"), F.count_distinct("key").alias("n_keys"))
    status = F.when(F.col("conflicts") > 0, "CONFLICTING").when((F.col("uncertain") > 0) & (F.col("current") == 0), "UNCERTAIN").otherwise("RESOLVED")
    return g.select(by, status.alias("status"), "n_keys")


def drifted_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Receipts that both sides hold: which fields differ, in the order given."""
    j = before.select(key, F.struct(*fields).alias("a")).join(after.select(key, F.struct(*fields).alias("b")), key)
    return j.select(key, F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])), ",").alias("drift"))


def tree_digest(records: DataFrame, by: str, number: str, digest: str, fan: int = 1000) -> DataFrame:
    """A digest of each set: of its records in blocks of `fan` numbers, of the blocks in blocks, until one is left."""
    level, most = records.select(by, F.col(number).alias("n"), F.col(digest).alias("h")), records.agg(F.max(number)).first()[0] or 0
    while True:
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), ","), 256)
        level = level.groupBy(by, F.floor(F.col("n") / fan).alias("n")).agg(joined.alias("h"), F.count("*").alias("_k")).select(by, "n", "h")
        most //= fan
        if most == 0:
            return level.select(by, F.col("h").alias("digest"))


def filed_requests(requests: DataFrame, v: DataFrame) -> DataFrame:
    """(request_id, corpus_id, as_of, path, prefix) -> versions visible to each request; a null path or prefix takes any."""
    under = F.col("r.prefix").isNull() | (F.col("v.path") == F.col("r.prefix")) | F.col("v.path").startswith(F.concat("r.prefix", F.lit("/")))
    on = (F.col("r.corpus_id") == F.col("v.corpus_id")) & (F.col("v.observed_at") <= F.col("r.as_of")) & (F.col("r.path").isNull() | (F.col("v.path") == F.col("r.path"))) & under
    hits = v.alias("v").join(requests.alias("r"), on).groupBy("r.request_id").agg(F.count("*").alias("n_versions"), F.count_distinct("v.doc_id").alias("n_documents"))
    return requests.select("request_id").join(hits, "request_id", "left").select("request_id", F.coalesce("n_versions", F.lit(0)).alias("n_versions"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def seal(v: DataFrame, cutoff: Column) -> DataFrame:
    """What a snapshot of each corpus held: number of versions and a digest of their ids, events and fingerprints.

    Versions are hashed, sorted in 65,536 buckets of their hashes, and the buckets' digests hashed in turn.
    """
    h = F.sha2(F.to_json(F.array(F.col("version_id").cast("string"), "event", "fp")), 256)
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256)
    buckets = v.where(F.col("observed_at") <= cutoff).select("corpus_id", h.alias("h")).groupBy("corpus_id", F.substring("h", 1, 4).alias("bucket")).agg(F.count("*").alias("n"), joined.alias("h"))
    return buckets.groupBy("corpus_id").agg(F.sum("n").alias("n"), joined.alias("digest"))


def broken_seals(sealed: DataFrame, now: DataFrame) -> DataFrame:
    j = sealed.join(now.withColumnsRenamed({"n": "n_now", "digest": "digest_now"}), "corpus_id", "full")
    return j.where(~(F.col("n").eqNullSafe(F.col("n_now")) & F.col("digest").eqNullSafe(F.col("digest_now")))).select("corpus_id", "n", "n_now")


def recall_at(ranked: DataFrame, gold: DataFrame, strategies: tuple[str, ...], ks: tuple[int, ...]) -> DataFrame:
    """(strategy, request_id, item_id, rank) against (request_id, item_id) -> per strategy the mean recall at each k and MRR."""
    wanted = gold.groupBy("request_id").agg(F.count("*").alias("n_gold"))
    hits = ranked.join(gold, ["request_id", "item_id"]).groupBy("strategy", "request_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.min("rank").alias("first"))
    every = wanted.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    j = every.join(hits, ["strategy", "request_id"], "left")
    return j.groupBy("strategy").agg(*[F.round(F.avg(F.coalesce(f"h{k}", F.lit(0)) / F.least("n_gold", F.lit(k))), 6).alias(f"recall_{k}") for k in ks], F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"))
