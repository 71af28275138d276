"""Matching of requests to claims, and classification of questions, claims and documents by stated rules.

Requests and claims meet through an inverted index. A request that needs m of its n terms is only looked up under its
n - m + 1 rarest ones: a claim with m of them holds at least one of these, and terms that are everywhere (which would pair
all requests with all claims) are left to the check that follows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import overlaps

# Words that carry no subject.
STOPWORDS = """a an the of for to in on at by from with without and or as well that this these those
is are was were be been being do does did done we our us you your i me my it its them
they their use uses used have has had can could would should shall will may might must
not no yes if then than so but about into over under again once here there all any both
each few more most other some such only own same too very just now also what which who
whom whose where when why how""".split()
# Words that frame a question about history.
FRAMING = "change changed history evolve evolved before previously replace replaced".split()
FLOOR, BAND = 0.30, 0.10  # fixed values: the least overlap of a relaxed match, and its distance to the best


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), 1))


def content_terms(text: Column, without: list[str] = ()) -> Column:
    """Distinct words but for those that carry no subject."""
    return F.array_except(words(text), F.array(*map(F.lit, [*STOPWORDS, *without])))


def claim_words(c: DataFrame) -> DataFrame:
    """corpus_id, claim_id, hay (words of key, sentence, value and path) and said (content words of the sentence)."""
    return c.select("corpus_id", "claim_id", words(F.concat_ws(" ", "key", "claim", F.col("val").cast("string"), "path")).alias("hay"), content_terms(F.col("claim")).alias("said"))


def candidates(asked: DataFrame, items: DataFrame, term: str, share: float | Column | None) -> DataFrame:
    """(request_id, corpus_id, terms) x items with an array `term` -> pairs that may share that part of the request's terms.

    share may be a column of asked; without one, only the rarest term of each request that any item holds is looked up.
    """
    posts = items.select("corpus_id", "item_id", F.explode(term).alias("t"))
    wanted = asked.select("corpus_id", F.explode("terms").alias("t")).distinct()
    df = posts.join(wanted, ["corpus_id", "t"], "left_semi").groupBy("corpus_id", "t").agg(F.count("*").alias("df"))
    least = F.lit(0.0) if share is None else share if isinstance(share, Column) else F.lit(share)
    probes = asked.select("request_id", "corpus_id", F.size("terms").alias("n"), least.alias("least"), F.explode("terms").alias("t")).join(df, ["corpus_id", "t"], "inner" if share is None else "left")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.coalesce("df", F.lit(0)), "t"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("least") - 1e-9))
    probes = probes.withColumn("place", place).where(F.col("place") <= (F.lit(1) if share is None else F.col("n") - needed + 1))
    return probes.join(posts, ["corpus_id", "t"]).select("request_id", "item_id").distinct()


def overlap(terms: str, other: str) -> Column:
    """Shared terms over the request's."""
    return F.size(F.array_intersect(terms, other)) / F.greatest(F.size(terms), F.lit(1))


def _asked(requests: DataFrame, without: list[str] = ()) -> DataFrame:
    return requests.select("request_id", "corpus_id", content_terms(F.col("text"), without).alias("terms")).where("size(terms) > 0")


def strict_match(requests: DataFrame, c: DataFrame) -> DataFrame:
    """(request_id, claim_id) where the claim holds every content word of the request."""
    asked, items = _asked(requests), claim_words(c).withColumnRenamed("claim_id", "item_id")
    pairs = candidates(asked, items, "hay", 1.0).join(asked, "request_id").join(items.drop("corpus_id"), "item_id")
    return pairs.where("size(array_except(terms, hay)) = 0").select("request_id", F.col("item_id").alias("claim_id"))


def relaxed_match(requests: DataFrame, c: DataFrame) -> DataFrame:
    """(request_id, claim_id, score) of requests that match nothing strictly: within BAND of the best overlap, from FLOOR up."""
    left = requests.join(strict_match(requests, c).select("request_id").distinct(), "request_id", "left_anti")
    asked, items = _asked(left), claim_words(c).withColumnRenamed("claim_id", "item_id")
    pairs = overlaps.best(overlaps.overlaps(asked, items, "said"), FLOOR, F.col("top") - F.col("score") <= BAND)
    return pairs.select("request_id", F.col("item_id").alias("claim_id"), F.round("score", 6).alias("score"))


def lineage_match(requests: DataFrame, c: DataFrame, chains: DataFrame) -> DataFrame:
    """(request_id, chain_id, score) of supersession chains whose claims together answer the request.

    A chain holds the union of its claims' words. Chains with all terms win; where there are none, those within BAND of the
    best overlap, if one of their claims reaches FLOOR by itself. The chains of a request's rarest term come first: what the
    best of them scores, less BAND, is the least that any other has to reach, so most requests ask for no common term.
    """
    asked = _asked(requests, FRAMING)
    claims = claim_words(c).join(chains, "claim_id")
    items = claims.groupBy("corpus_id", F.col("chain_id").alias("item_id")).agg(F.array_distinct(F.flatten(F.collect_set("hay"))).alias("hay"), F.array_distinct(F.flatten(F.collect_set("said"))).alias("said"))
    own = claims.select(F.col("chain_id").alias("item_id"), F.col("hay").alias("own_hay"), F.col("said").alias("own_said"))
    both = items.withColumn("both", F.array_union("hay", "said"))
    whole = F.size(F.array_except("terms", "hay")) == 0
    score = F.when(whole, 2.0).when(F.col("own") >= FLOOR, overlap("terms", "said")).otherwise(0.0)

    def scored(near: DataFrame) -> DataFrame:
        near = near.join(asked, "request_id")
        able = near.join(own, "item_id").groupBy("request_id", "item_id").agg(F.max(F.greatest(overlap("terms", "own_hay"), overlap("terms", "own_said"))).alias("own"))
        return near.join(items.drop("corpus_id"), "item_id").join(able, ["request_id", "item_id"]).select("request_id", "item_id", score.alias("score")).where(F.col("score") >= FLOOR)

    reached = durable(scored(candidates(asked, both, "both", None)).groupBy("request_id").agg(F.max("score").alias("reached")))
    least = F.when(F.col("reached") == 2, 1.0).otherwise(F.greatest(F.lit(FLOOR), F.coalesce("reached", F.lit(0.0)) - BAND))
    pairs = scored(candidates(asked.join(reached, "request_id", "left"), both, "both", least))
    best = F.max("score").over(Window.partitionBy("request_id"))
    kept = pairs.withColumn("best", best).where((F.col("best") - F.col("score") <= BAND) & ((F.col("best") < 2) | (F.col("score") == 2)))
    return kept.select("request_id", F.col("item_id").alias("chain_id"), F.round(F.least("score", F.lit(1.0)), 6).alias("score"))


# The rules of a question's intent, first match wins.
INTENTS = {
    "conflict": r"\b(conflict\w*|disagree\w*|contradict\w*)\b",
    "provenance": r"\b(evidence|provenance|source|sources|quote)\b",
    "change": r"\b(changed?|replaced?|supersed\w*)\b",
    "current": r"\b(now|currently|current)\b",
    "historical": r"\b(before|after|previous(ly)?|former(ly)?|used to|histor(y|ical|ies)|earlier|old(er)?|prior)\b",
}


def first_rule(text: Column, rules: dict[str, str], otherwise: str) -> Column:
    return functools.reduce(lambda out, rule: F.when(text.rlike(rule[1]), rule[0]).otherwise(out), reversed(rules.items()), F.lit(otherwise))


def intents(questions: DataFrame) -> DataFrame:
    """question_id, text -> intent, cutoff (the one ISO date in the text, midnight UTC) and error."""
    low = F.lower("text")
    dates = F.regexp_extract_all(low, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1)
    cutoff = F.try_to_timestamp(F.element_at(dates, F.when(F.size(dates) == 1, 1)), F.lit("yyyy-MM-dd"))
    error = F.when(F.trim("text") == "", "invalid_query").when(F.size(dates) > 1, "several_dates").when((F.size(dates) == 1) & cutoff.isNull(), "invalid_date").when((F.size(dates) == 0) & low.rlike(r"\bstage\s+[a-z0-9]+\b"), "stage_without_cutoff")
    intent = F.when(error.isNull(), F.when(cutoff.isNotNull(), "temporal").otherwise(first_rule(low, INTENTS, "current")))
    return questions.select("question_id", intent.alias("intent"), F.when(error.isNull(), cutoff).alias("cutoff"), error.alias("error"))


# Words that make a claim a rule, a decision or an observation.
ROLES = {
    "rule": "must|never|avoid|prohibited|should|always|cannot",
    "decision": "approved|rejected|abandoned|selected|decided",
    "observation": "conversion|engagement|outperformed|missed target|worked better",
}


def role(claim: Column, heading: Column) -> Column:
    return F.when(F.lower(heading).rlike("example|approved copy|sample"), "example").otherwise(first_rule(F.lower(claim), ROLES, "fact"))


# Authority states from the least to the most restrictive, and the values and heading words that declare them.
STATES = ("approved", "inferred_insight", "historical_observation", "draft", "superseded", "rejected")
STATE_VALUES = {
    "approved": ("approved", "final", "published", "live", "current"),
    "draft": ("draft", "wip", "work in progress", "brainstorm", "unapproved"),
    "rejected": ("rejected",),
    "superseded": ("superseded", "deprecated", "obsolete", "archived"),
    "historical_observation": ("historical", "past campaign"),
    "inferred_insight": ("inferred", "unreviewed"),
}
HEADING_WORDS = {
    "draft": ("draft", "drafts", "brainstorm", "brainstorming", "work in progress", "wip"),
    "rejected": ("rejected",),
    "superseded": ("superseded", "deprecated", "obsolete", "archive", "archived"),
    "historical_observation": ("past campaigns", "lessons learned", "performance report"),
}


def rank_of(value: Column) -> Column:
    """The rank of the state that a whole value declares; null for none."""
    value = F.lower(F.trim(value))
    return functools.reduce(lambda out, s: F.when(value.isin(*STATE_VALUES[s]), STATES.index(s)).otherwise(out), STATE_VALUES, F.lit(None).cast("int"))


def heading_rank(part: Column) -> Column:
    """The rank of the state that a heading declares by its first word, alone or before a space, colon or dash."""
    text = F.lower(F.trim(F.regexp_replace(part, r"\s+", " ")))
    ranks = [F.when(text.rlike(f"^({'|'.join(HEADING_WORDS[s])})($|[ :-])"), STATES.index(s)) for s in HEADING_WORDS]
    return F.greatest(*ranks)


def state_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), F.coalesce(rank, F.lit(0)) + 1)


def document_states(docs: DataFrame) -> DataFrame:
    """doc_id, status, tags (comma-separated) -> the most restrictive state declared, its rank, and a warning."""
    tag = F.array_max(F.transform(F.split("tags", ","), rank_of))
    rank = F.coalesce(F.greatest(rank_of(F.col("status")), tag), F.lit(0))
    unknown = (F.trim("status") != "") & rank_of(F.col("status")).isNull()
    return docs.select("doc_id", rank.alias("rank"), state_name(rank).alias("state"), F.when(unknown, F.concat(F.lit("unknown_status:"), F.lower(F.trim("status")))).alias("warning"))


def combined_states(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims (claim_id, doc_id, heading_path) take the more restrictive of their document's state and their heading path's."""
    path = F.coalesce(F.array_max(F.transform(F.split("heading_path", " > "), heading_rank)), F.lit(0))
    return claims.select("claim_id", "doc_id", path.alias("own")).join(docs.select("doc_id", "rank"), "doc_id").select("claim_id", state_name(F.greatest("own", "rank")).alias("state"))


def resolve_scopes(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """(request_id, principal, corpus_id or null) -> the corpus that the request reads, or why it reads none."""
    own = grants.groupBy("principal").agg(F.count_distinct("corpus_id").alias("n"), F.min("corpus_id").alias("sole"))
    named = grants.select("principal", "corpus_id", F.lit(True).alias("granted")).distinct()
    j = requests.join(own, "principal", "left").join(named, ["principal", "corpus_id"], "left")
    outcome = F.when(F.col("corpus_id").isNotNull(), F.when(F.col("granted"), "named").otherwise("forbidden")).when(F.col("n") == 1, "sole").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return j.select("request_id", outcome.alias("outcome"), F.when(outcome == "named", F.col("corpus_id")).when(outcome == "sole", F.col("sole")).alias("corpus_id"))


def document_references(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(ref_id, ref) -> the document of that path or of the one path that ends in /ref, in any case; else why not."""
    parts = F.split(F.lower("path"), "/")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    ends = docs.select("doc_id", F.lower("path").alias("whole"), suffix.alias("needle"))
    j = refs.select("ref_id", F.lower("ref").alias("needle")).join(ends, "needle", "left")
    g = j.groupBy("ref_id").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("any"), F.min(F.when(F.col("whole") == F.col("needle"), F.col("doc_id"))).alias("exact"))
    outcome = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return g.select("ref_id", outcome.alias("outcome"), F.when(outcome == "exact", F.col("exact")).when(outcome == "suffix", F.col("any")).alias("doc_id"))


SPREAD = 16


def any_selectors(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of each request by its selectors corpus_id, document_type, since, until; a null selector takes any.

    Undated documents go where a date bounds the request. A document goes by its corpus and type, by one of them and by
    neither; a request asks by those it names, so they meet by equality, and dates are checked on what meets. Documents of
    one corpus and type are spread over SPREAD shares, each of which every request for them reads.
    """
    named = lambda x: F.array(F.lit(None).cast("string"), F.col(x))
    d = docs.select("id", "date", F.explode(F.array_distinct(named("corpus_id"))).alias("c"), "document_type").select("id", "date", "c", F.explode(F.array_distinct(named("document_type"))).alias("t"))
    d = d.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int"))
    r = requests.select("request_id", F.col("corpus_id").alias("_c"), F.col("document_type").alias("_t"), "since", "until", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_share"))
    same = F.col("c").eqNullSafe(F.col("_c")) & F.col("t").eqNullSafe(F.col("_t")) & (F.col("share") == F.col("_share"))
    dated = (F.col("since").isNull() | (F.col("date") >= F.col("since"))) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))
    return d.join(r, same & dated).select("request_id", "id")
