"""Exact vector search, retrieval metrics, live-index maintenance and log aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators import blocks

BROADCAST_QUERIES = 20_000


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored_pairs(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, vector) x (item_id, vector) -> the dot product of each query with every other item.

    A stated query set against all rows: the queries are broadcast up to a checked number, else Spark picks the join.
    """
    q = queries.select("query_id", F.col("vector").alias("_q"))
    q = F.broadcast(q) if q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else q
    return items.select("item_id", F.col("vector").alias("_v")).join(q, F.col("item_id") != F.col("query_id")).select("query_id", "item_id", F.round(dot("_q", "_v"), 6).alias("score"))


def whole(vector: str) -> Column:
    """The vector, null where a component is."""
    return F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector))


def top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k nearest other items of each query, ties by item_id; pairs are scored in blocks and never stored."""
    feature = whole("vector").alias("feature")
    return blocks.nearest(queries.select("query_id", feature), items.select("item_id", feature), k, blocks.dots)


def labelled(ranked: DataFrame, queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, label) x (item_id, label) -> the ranked pairs of one label, and (query_id, n): how many other items have it.

    An item is relevant to a query of its label; those are counted by label, not listed.
    """
    pairs = ranked.select("query_id", "item_id").join(queries, "query_id").join(items, ["item_id", "label"]).select("query_id", "item_id")
    own = items.groupBy(F.col("item_id").alias("query_id"), "label").agg(F.count("*").alias("_own"))
    n = queries.join(items.groupBy("label").agg(F.count("*").alias("_all")), "label").join(own, ["query_id", "label"], "left")
    return pairs, n.select("query_id", (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("n")).where("n > 0")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """Per query: recall@k, precision@k, reciprocal rank and binary nDCG@k; with total (query_id, n) relevant may leave out what is not ranked."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n")) if total is None else total
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    per = hits.groupBy("query_id").agg(F.sum("hit").alias("h"), F.count("*").alias("r"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.join(total, "query_id").select("query_id", F.round(F.col("h") / F.col("n"), 6).alias("recall"), F.round(F.col("h") / F.col("r"), 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def reconcile(source: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, hash) against (path, hash): added, changed, unchanged, deleted."""
    j = source.select("path", F.col("hash").alias("new")).join(manifest.select("path", F.col("hash").alias("old")), "path", "full_outer")
    return j.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged").alias("outcome"))


def document_frequency(rows: DataFrame, terms: str = "terms") -> DataFrame:
    return rows.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


CUTS = 64


def values_at(rows: DataFrame, by: str, value: str, places: Callable[[Column], Column]) -> DataFrame:
    """(by, n, place, value): a group's values at `places(n)` (an array of places from 0) of its sorted ones; nulls do not count.

    Equal values are counted first. CUTS quantiles of a group's different values (a sketch of bounded size) cut them into
    ranges of about equal size, whose counts say exactly in which range a place lies; only such ranges are put in order. So
    no group is sorted whole, however its values are spread, and a poor sketch costs time, not correctness.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    cuts = F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 1000)
    # cut off: a sketch depends on the order in which its parts arrive, so two evaluations may differ, and both uses need the same
    span = durable(counts.groupBy(F.col(by).alias("_by")).agg(F.sum("c").alias("n"), cuts.alias("_cuts")))
    binned = counts.join(span, F.col(by).eqNullSafe(F.col("_by"))).select(by, value, "c", "n", F.size(F.filter("_cuts", lambda x: x < F.col(value))).alias("_bin"))
    before = F.sum("_c").over(Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = binned.groupBy(by, "n", "_bin").agg(F.sum("c").alias("_c")).withColumn("_before", F.coalesce(before, F.lit(0)))
    asked = F.filter(F.array_distinct(places(F.col("n"))), lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_c")))
    hit = bins.select(F.col(by).alias("_by"), F.col("_bin").alias("_hit"), "_before", asked.alias("_asked")).where("size(_asked) > 0")
    held = binned.join(hit, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bin") == F.col("_hit")))
    upto = F.col("_before") + F.sum("c").over(Window.partitionBy(by, "_bin").orderBy(value))
    own = F.filter("_asked", lambda p: (F.col("_upto") - F.col("c") <= p) & (p < F.col("_upto")))
    return held.withColumn("_upto", upto).select(by, "n", F.explode(own).alias("place"), value)


def latency_percentile(log: DataFrame, share: float = 0.95) -> DataFrame:
    """The element at int(share * (n - 1)) of the sorted latencies of each operation."""
    at = values_at(log, "operation", "latency_ms", lambda n: F.array(F.floor(F.lit(share) * (n - 1))))
    return at.select("operation", "n", F.col("latency_ms").alias("p95"))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the middle value, or the mean of the two middle ones."""
    at = values_at(rows, by, value, lambda n: F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    return at.groupBy(by).agg(F.avg(F.col(value).cast("double")).alias("median"))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, text) x (item_id, passage) -> (doc_id, item_id) where the text holds the passage, character by character.

    Each passage goes to the documents that have its rarest inner word (one with white space on both sides, which any text
    that holds the passage has as a whole word), and is confirmed there; a passage without one goes by its first characters,
    four at most. So a passage meets the documents of one word, not all; only words and characters that are asked for leave
    the scan. Null texts and passages give nothing, an empty passage is in every text, repeated rows give a row each.
    """
    asked = passages.where("passage is not null")
    inner = F.slice(F.split("passage", r"[\x20\x09-\x0D]+", -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split("passage", r"[\x20\x09-\x0D]+", -1)) - 2))
    asked = asked.withColumn("_inner", F.array_distinct(inner))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    words = asked.select(F.explode("_inner").alias("word")).distinct()
    postings = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+", -1))).alias("word")).join(words, "word", "left_semi").distinct()
    df = words.join(postings.groupBy("word").agg(F.count("*").alias("df")), "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))
    rarest = asked.where("size(_inner) > 0").select("passage", F.explode("_inner").alias("word")).distinct().join(df, "word").groupBy("passage").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    by_word = postings.join(rarest, "word").select("doc_id", "passage")
    heads = asked.where("size(_inner) = 0").select("passage", F.substring("passage", 1, 4).alias("head")).distinct()
    sizes = heads.agg(F.collect_set(F.length("head")).alias("sizes"))  # five numbers at most
    starts = lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: F.substr(F.col("text"), i, n)))
    grams = texts.join(F.broadcast(sizes)).where("size(sizes) > 0").select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform("sizes", starts)))).alias("head"))
    by_head = grams.join(heads.select("head").distinct(), "head", "left_semi").distinct().join(heads, "head").select("doc_id", "passage")
    met = by_word.union(by_head)
    found = texts.join(met, "doc_id").where(F.contains("text", F.col("passage"))).select("doc_id", "passage")
    return found.join(asked.select("item_id", "passage"), "passage").select("doc_id", "item_id")
