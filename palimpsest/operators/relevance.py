"""Relevance of documents to questions: terms, idf-weighted overlap, trigram similarity, fusion, adjudication, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from palimpsest.functions.durable import durable
from palimpsest.operators import blocks

SUFFIXES = ("ation", "ing", "ed", "s")  # fixed values: the first that fits is cut, if more than three letters stay
BROADCAST_TERMS = 200_000
# Function words and words of time, which are no evidence of a subject.
STOP = """a an the of for to in on at by from with without and or as well
what which who where when why how is are was were be been do does did we our it
its them they their this that these those use uses used currently current now
previous previously before after then than rather during once still already
have has had can could would should will may might selected decision decisions
architecture project system application documented fact contract assertion
source sources document documents claim claims evidence exact show tell list
about regarding both also same all any each one two know known knowledge
stage checkpoint pilot cutover expansion federation clarification restored
restoration deleted deletion historical history formerly earlier later old
looking back today tomorrow setting aside ignore regardless between until""".split()


def stem(term: Column) -> Column:
    out = term
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        out = F.when(term.endswith(suffix) & (F.length(term) > n + 3), term.substr(F.lit(1), F.length(term) - n)).otherwise(out)
    return out


def terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]+)"), 1), stem))


def subject_terms(text: Column) -> Column:
    """Terms but for the words that are no evidence of a subject."""
    words = F.array_except(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]+)"), 1), F.array(*map(F.lit, STOP)))
    return F.array_distinct(F.transform(words, stem))


def small(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """A broadcast hint only where the table has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def overlap_scores(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, text) x (doc_id, text) -> the idf-weighted share of a question's terms that a document holds.

    An inverted-index join: only postings of the questions' terms leave the scan, and pairs without a common term never
    appear. Terms that no document holds weigh most.
    """
    asked = questions.select("question_id", F.explode(subject_terms(F.col("text"))).alias("term"))
    wanted = small(asked.select("term").distinct())
    postings = durable(docs.select("doc_id", F.explode(subject_terms(F.col("text"))).alias("term")).join(wanted, "term", "left_semi"))  # texts are read once
    n = docs.agg(F.count("*").alias("n_docs"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = durable(asked.join(df, "term", "left").join(F.broadcast(n)).select("question_id", "term", idf.alias("idf")))
    total = weighed.groupBy("question_id").agg(F.sum("idf").alias("total"))
    hits = postings.join(small(weighed), "term").groupBy("question_id", "doc_id").agg(F.sum("idf").alias("hit"))
    return hits.join(small(total), "question_id").select("question_id", "doc_id", F.round(F.col("hit") / F.col("total"), 6).alias("score"))


def term_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text (one row a document) -> postings (doc_id, term) and one row with the number of documents."""
    return docs.select("doc_id", F.explode(subject_terms(F.col("text"))).alias("term")), docs.agg(F.count("*").alias("n_docs"))


def threshold_heads(questions: DataFrame, index: tuple[DataFrame, DataFrame], least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weighed terms (question_id, term, idf, total, head), postings of the terms asked, and candidates (question_id, doc_id).

    A question's terms go from the rarest on; one belongs to its head while it and those after it weigh `least` of the whole
    or more. A document without a term of the head has too little left to reach `least`, so it never becomes a candidate.
    """
    asked = questions.select("question_id", F.explode(subject_terms(F.col("text"))).alias("term"))
    held = durable(index[0].join(small(asked.select("term").distinct()), "term", "left_semi"))  # texts are read once
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = asked.join(df, "term", "left").join(F.broadcast(index[1])).select("question_id", "term", F.coalesce("df", F.lit(0)).alias("df"), idf.alias("idf"))
    own = Window.partitionBy("question_id")
    rest = F.sum("idf").over(own.orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0))
    weighed = weighed.withColumns({"total": F.sum("idf").over(own), "_rest": rest})
    weighed = durable(weighed.select("question_id", "term", "idf", "total", (F.round(F.col("_rest") / F.col("total"), 9) >= least - 1e-6).alias("head")))
    candidates = durable(held.join(small(weighed.where("head").select("question_id", "term")), "term").select("question_id", "doc_id").distinct())
    return weighed, held, candidates


def overlap_above(questions: DataFrame, index: tuple[DataFrame, DataFrame], least: float, heads: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """The rows of overlap_scores with a score of `least` or more (above 0), without meeting the pairs that cannot reach it.

    index: term_index of the documents; heads: what threshold_heads made of it, where that is there already. Candidates are
    scored on the whole term sets of both sides.
    """
    weighed, held, candidates = heads or threshold_heads(questions, index, least)
    asked = weighed.groupBy("question_id").agg(F.collect_list(F.struct("term", "idf")).alias("asked"), F.max("total").alias("total"))
    terms = held.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    both = F.filter("asked", lambda a: F.array_contains("terms", a["term"]))
    hit = F.aggregate(both, F.lit(0.0), lambda x, a: x + a["idf"])
    scored = candidates.join(asked, "question_id").join(terms, "doc_id").select("question_id", "doc_id", F.round(hit / F.col("total"), 6).alias("score"))
    return scored.where(F.col("score") >= least)


def best(scores: DataFrame, by: str, item: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def adjudicate(questions: DataFrame, scores: DataFrame, least: float, margin: float) -> DataFrame:
    """confident, ambiguous (the runner-up is within the margin) or abstained (nothing reaches `least`)."""
    top = best(scores, "question_id", "doc_id", 2).groupBy("question_id").agg(F.max("score").alias("top"), F.min(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("doc_id"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    gap = F.round(F.col("top") - F.coalesce("second", F.lit(0.0)), 6)
    outcome = F.when(F.col("top").isNull() | (F.col("top") < least), "abstained").when(gap < margin, "ambiguous").otherwise("confident")
    return questions.select("question_id").join(top, "question_id", "left").select("question_id", outcome.alias("outcome"), F.when(outcome != "abstained", F.col("doc_id")).alias("doc_id"), gap.alias("margin"))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the words, each padded by two spaces before and one after."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))))


def gram_sets(rows: DataFrame) -> DataFrame:
    """(id, text) -> (id, feature): the trigrams as numbers; a null text has none."""
    key = next(c for c in rows.columns if c != "text")
    return rows.select(key, F.coalesce(blocks.gram_numbers(trigrams(F.col("text"))), F.array().cast("array<int>")).alias("feature"))


def trigram_scores(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, text) x (item_id, text) -> similarity of the pairs that share a trigram."""
    q = queries.select("query_id", trigrams(F.col("text")).alias("g")).select("query_id", F.size("g").alias("nq"), F.explode("g").alias("gram"))
    i = items.select("item_id", trigrams(F.col("text")).alias("g")).select("item_id", F.size("g").alias("ni"), F.explode("g").alias("gram"))
    both = i.join(small(q), "gram").groupBy("query_id", "item_id", "nq", "ni").agg(F.count("*").alias("both"))
    return both.select("query_id", "item_id", F.round(F.col("both") / (F.col("nq") + F.col("ni") - F.col("both")), 6).alias("score"))


ID_RANGE = 65_536


def smaller_ids(items: DataFrame) -> DataFrame:
    """(item_id), different numbers -> (item_id, below): how many are smaller. Ranges of ids are counted, then each is put in order."""
    ranged = items.select("item_id", F.floor(F.col("item_id") / ID_RANGE).alias("_range"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("item_id")) - 1
    return ranged.join(starts, "_range").select("item_id", (F.col("_before") + own).alias("below"))


def better_than(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, key) x (query_id, key) -> for each key asked, the number of the query's pairs with a smaller one.

    Each pair only says between which two of the asked keys it lies, and is counted there before the shuffle: no query's list
    is put in order. The keys asked of a query are few, by the caller's bound.
    """
    sorted_ = asked.groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("_keys"))
    place = F.size(F.filter("_keys", lambda x: x <= F.col("key"))).alias("_place")
    n = pairs.join(small(sorted_), "query_id").select("query_id", place).groupBy("query_id", "_place").agg(F.count("*").alias("_n"))
    slots = sorted_.select("query_id", F.posexplode("_keys").alias("_place", "key")).join(n, ["query_id", "_place"], "left")
    upto = F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("query_id").orderBy("_place"))
    return slots.select("query_id", "key", upto.alias("n_better"))


def fuse(vector: DataFrame, keyword: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two whole lists (query_id, item_id, score): the k best of each query, with their weighted blend.

    vector has a score for every pair, keyword for those above 0, all others score 0 there; ties go by id; items (item_id) are
    what both rank. Neither list is put in order. The k first of a list score more than 1 / (60 + k) each; what lies behind
    place 2k + 60 in both scores less. So the first 2k + 60 of each list hold the answer, and only their places in the other
    list are counted.
    """
    depth = 2 * k + 60
    none = F.lit(0).cast("double")
    by_vector, by_word = (best(x, "query_id", "item_id", depth).select("query_id", "item_id") for x in (vector, keyword))
    held = keyword.groupBy("query_id").agg(F.count("*").alias("held"))
    queries = vector.select("query_id").distinct().join(held, "query_id", "left").select("query_id", F.coalesce("held", F.lit(0)).alias("held"))
    lowest = items.select("item_id").orderBy("item_id").limit(2 * depth + 1)  # what score 0 adds to the first of a short list
    filled = queries.where(F.col("held") < depth).join(F.broadcast(lowest)).where("query_id <> item_id").select("query_id", "item_id")
    both = by_vector.union(by_word).union(filled).distinct().join(vector.withColumnRenamed("score", "v"), ["query_id", "item_id"])
    both = both.join(keyword.withColumnRenamed("score", "w"), ["query_id", "item_id"], "left").withColumn("w", F.coalesce("w", none))
    both = durable(both.join(queries, "query_id").join(smaller_ids(items), "item_id"))
    order = lambda score: F.struct((-F.col(score)).alias("a"), F.col("item_id").alias("b"))
    v = better_than(vector.select("query_id", order("score").alias("key")), both.select("query_id", order("v").alias("key")))
    w = better_than(keyword.select("query_id", order("score").alias("key")), both.where("w > 0").select("query_id", order("w").alias("key")))
    i = better_than(keyword.select("query_id", F.col("item_id").alias("key")), both.where("w = 0").select("query_id", F.col("item_id").alias("key")))
    at = lambda df, name: df.select("query_id", F.col("key.b").alias("item_id"), F.col("n_better").alias(name))
    j = both.join(at(v, "_v"), ["query_id", "item_id"]).join(at(w, "_w"), ["query_id", "item_id"], "left").join(i.select("query_id", F.col("key").alias("item_id"), F.col("n_better").alias("_i")), ["query_id", "item_id"], "left")
    unheld = F.col("held") + F.col("below") - (F.col("query_id") < F.col("item_id")).cast("int") - F.col("_i")
    score = F.round(1 / (61.0 + F.col("_v")) + 1 / (61.0 + F.coalesce("_w", unheld)), 9)
    return best(j.select("query_id", "item_id", score.alias("score"), F.round(0.7 * F.col("v") + 0.3 * F.col("w"), 8).alias("blend")), "query_id", "item_id", k)


def fuse_blocks(vector: tuple[DataFrame, DataFrame], keyword: tuple[DataFrame, DataFrame], items: DataFrame, k: int) -> DataFrame:
    """fuse() over lists that are never stored: (query_id, feature) x (item_id, feature) by vector and by set of trigrams.

    The first 2k + 60 of each list come out of blocks, then their scores and their places in the other list.
    """
    depth = 2 * k + 60
    of_vectors, of_sets = {"scorer": blocks.dots}, {"scorer": blocks.common_share}
    by_vector = durable(blocks.nearest(*vector, depth, **of_vectors).select("query_id", "item_id"))
    by_word = durable(blocks.nearest(*keyword, depth, **of_sets, positive=True).select("query_id", "item_id"))
    held = by_word.groupBy("query_id").agg(F.count("*").alias("n"))
    lowest = items.select("item_id").orderBy("item_id").limit(2 * depth + 1)  # what score 0 adds to the first of a short list
    filled = vector[0].select("query_id").join(held, "query_id", "left").where(F.coalesce("n", F.lit(0)) < depth).join(F.broadcast(lowest)).where("query_id <> item_id").select("query_id", "item_id")
    asked = durable(by_vector.union(by_word).union(filled).distinct())
    v = durable(blocks.scores_of(*vector, asked, **of_vectors))
    w = durable(blocks.scores_of(*keyword, asked, **of_sets, sets=True))
    key = ["query_id", "item_id"]
    at_v = blocks.places(*vector, v, **of_vectors).select(*key, F.col("n_better").alias("_v"))
    at_w = blocks.places(*keyword, w, **of_sets, sets=True).select(*key, F.col("n_better").alias("_w"), "held")
    j = v.withColumnRenamed("score", "v").join(w.withColumnRenamed("score", "w"), key).join(at_v, key).join(at_w, key).join(smaller_ids(items), "item_id")
    unheld = F.col("held") + F.col("below") - (F.col("query_id") < F.col("item_id")).cast("int") - F.col("_w")
    score = F.round(1 / (61.0 + F.col("_v")) + 1 / (61.0 + F.when(F.col("w") > 0, F.col("_w")).otherwise(unheld)), 9)
    return best(j.select(*key, score.alias("score"), F.round(0.7 * F.col("v") + 0.3 * F.col("w"), 8).alias("blend")), "query_id", "item_id", k)


def prefix_budget(rows: DataFrame, by: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows in order until the first that does not fit."""
    running = F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= budget)


def skip_budget(rows: DataFrame, by: str, budget: int, most: int | None = None) -> DataFrame:
    """(by, id, score, size): candidates of a request in order, skipping those that no longer fit; with `most`, its top ones.

    Once a candidate of some size does not fit, none of that size fits later: of each size at most budget / size are ever
    taken, the first ones. So all others are left out before a request becomes one group, which is then bounded by the
    budget alone (about budget * ln(budget) rows), however many candidates the request has. Sizes count as 1 at least.
    """
    sized = rows.select(by, "id", "score", F.greatest("size", F.lit(1).cast(rows.schema["size"].dataType)).alias("size"))
    if most is not None:
        sized = best(sized, by, "id", most).drop("rank")
    place = F.row_number().over(Window.partitionBy(by, "size").orderBy(F.desc("score"), "id"))
    able = sized.where(F.col("size") <= budget).withColumn("_place", place).where((F.col("_place") <= budget) & (F.col("_place") * F.col("size") <= budget)).drop("_place")

    def take(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        left, keep = budget, []
        for size in part["size"]:
            keep.append(size <= left)
            left -= size * keep[-1]
        part = part.loc[keep, [by, "id", "size"]]
        return part.assign(rank=range(1, len(part) + 1))

    return able.groupBy(by).applyInPandas(take, able.select(by, "id", "size").schema.add("rank", IntegerType()))


def related(docs: DataFrame, asked: Column) -> DataFrame:
    """Documents by the number of tags they share with each asked one; pairs meet by tag, from the asked side only."""
    t = docs.select("corpus_id", "id", F.explode(F.array_distinct("tags")).alias("tag"))
    q = small(docs.where(asked).select("corpus_id", F.col("id").alias("query_id"), F.explode(F.array_distinct("tags")).alias("tag")))
    return t.join(q, ["corpus_id", "tag"]).where("id <> query_id").groupBy("query_id", "id").agg(F.count("*").alias("score"))


def related_best(docs: DataFrame, asked: Column, k: int) -> DataFrame:
    """The k best rows of related() for each asked document, ties by id, with their rank.

    Documents of a corpus with the same tags are one class. Classes meet by tag, and of each only the k + 1 first ids can be
    among the best (one may be the asked document itself), so pairs of documents are never made.
    """
    d = docs.select("corpus_id", "id", F.array_sort(F.array_compact(F.array_distinct("tags"))).alias("tags"))
    first = lambda df, by, order: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k + 1).drop("_r")
    held = first(d, ["corpus_id", "tags"], ["id"])
    queries = d.where(asked).select("corpus_id", F.col("id").alias("query_id"), F.col("tags").alias("wanted"))
    a = queries.select("corpus_id", "wanted").distinct().withColumn("tag", F.explode("wanted"))
    b = d.select("corpus_id", "tags").distinct().withColumn("tag", F.explode("tags"))
    kinds = a.join(b, ["corpus_id", "tag"]).groupBy("corpus_id", "wanted", "tags").agg(F.count("*").alias("score"))
    met = first(kinds.join(held, ["corpus_id", "tags"]), ["corpus_id", "wanted"], [F.desc("score"), "id"])
    return best(queries.join(met, ["corpus_id", "wanted"]).where("id <> query_id").select("query_id", "id", "score"), "query_id", "id", k)


def recency_blend(scored: DataFrame) -> DataFrame:
    """(query_id, item_id, score) -> 0.7 of the score and 0.3 of the item's place in the order of ids."""
    place = F.percent_rank().over(Window.partitionBy("query_id").orderBy("item_id"))
    return scored.withColumn("score", F.round(0.7 * F.col("score") + 0.3 * place, 8))


def hash_embedding(rows: DataFrame, key: str, buckets: int = 384) -> DataFrame:
    """(key, text) -> sparse (key, bucket, weight): token counts by hashed bucket, of unit length."""
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("token")
    bucket = F.conv(F.substring(F.sha2("token", 256), 1, 8), 16, 10).cast("long") % buckets
    n = rows.select(key, token).groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    norm = n.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, key).select(key, "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))
