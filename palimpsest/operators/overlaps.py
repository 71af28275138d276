"""Requests against items by the share of a request's terms that an item holds, without a row for each pair.

Terms are common, if more than COMMON items of a corpus hold them, or rare. Pairs that share a rare term are met one by one,
COMMON at most for each of a request's terms. All other pairs share common terms only: items with the same common terms are
one class and requests with the same ones one kind, so whole classes are counted, compared and cut instead of their items.
What a result has to list is listed; nothing that shares a term is left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable
from palimpsest.operators.relevance import small

COMMON = 1_000


class Overlaps(NamedTuple):
    asked: DataFrame  # request_id, corpus_id, n (its terms), wanted (its common ones)
    items: DataFrame  # corpus_id, item_id, held (its common terms); those with any term asked
    near: DataFrame  # request_id, item_id, n, shared, plain: pairs with a rare term in common; plain counts the common ones
    kinds: DataFrame  # corpus_id, wanted, held, plain: sets of common terms that meet


def overlaps(asked: DataFrame, items: DataFrame, term: str, common: int = COMMON) -> Overlaps:
    """(request_id, corpus_id, terms) and (corpus_id, item_id) with an array `term`, both of different terms."""
    key = ["corpus_id", "t"]
    sized = durable(asked.select("request_id", "corpus_id", F.size("terms").alias("n"), F.explode("terms").alias("t")))
    held = durable(items.select("corpus_id", "item_id", F.explode(term).alias("t")).join(small(sized.select(*key).distinct()), key, "left_semi"))
    often = small(durable(held.groupBy(*key).agg(F.count("*").alias("df")).where(F.col("df") > common).select(*key, F.lit(True).alias("_often"))))
    names = F.array_sort(F.collect_set(F.when(F.col("_often"), F.col("t"))))
    told = durable(sized.join(often, key, "left").groupBy("request_id", "corpus_id", "n").agg(names.alias("wanted")))
    classed = durable(held.join(often, key, "left").groupBy("corpus_id", "item_id").agg(names.alias("held")))
    rare = sized.join(often, key, "left_anti").select("request_id", *key)
    near = rare.join(held.join(often, key, "left_anti"), key).groupBy("request_id", "corpus_id", "item_id").agg(F.count("*").alias("_rare"))
    near = near.join(told, ["request_id", "corpus_id"]).join(classed, ["corpus_id", "item_id"]).withColumn("plain", F.size(F.array_intersect("wanted", "held")).cast("long"))
    a = told.select("corpus_id", "wanted").distinct().withColumn("t", F.explode("wanted"))
    b = classed.select("corpus_id", "held").distinct().withColumn("t", F.explode("held"))
    kinds = durable(a.join(b, key).groupBy("corpus_id", "wanted", "held").agg(F.count("*").alias("plain")))
    return Overlaps(told, classed, durable(near.select("request_id", "item_id", "n", (F.col("_rare") + F.col("plain")).alias("shared"), "plain")), kinds)


def share(n: str) -> Column:
    """So many of a request's terms, as a share."""
    return F.col(n) / F.col("n")


def by_class(x: Overlaps, floor: float) -> DataFrame:
    """request_id, corpus_id, held, score: classes that reach the floor by common terms alone."""
    met = x.asked.join(small(x.kinds), ["corpus_id", "wanted"]).select("request_id", "corpus_id", "held", share("plain").alias("score"))
    return met.where(F.col("score") >= floor)


def counts(x: Overlaps, floor: float) -> DataFrame:
    """request_id, n, best: how many items reach the floor, and the best share."""
    sizes = x.items.groupBy("corpus_id", "held").agg(F.count("*").alias("c"))
    plain = by_class(x, floor).join(small(sizes), ["corpus_id", "held"]).select("request_id", "c", "score")
    near = x.near.where(share("shared") >= floor).select("request_id", (share("plain") < floor).cast("long").alias("c"), share("shared").alias("score"))
    return plain.union(near).groupBy("request_id").agg(F.sum("c").alias("n"), F.max("score").alias("best"))


def best(x: Overlaps, floor: float, kept: Column, groups: DataFrame | None = None) -> DataFrame:
    """request_id, item_id, score: what reaches the floor and passes a test `kept` of score and top, the request's best.

    The test must not turn away a score for being higher. With groups (item_id, group) a group counts as its best item does,
    and the rows are request_id, group, score.
    """
    name = "item_id" if groups is None else "group"
    of = lambda rows: rows if groups is None else rows.join(groups, "item_id")
    plain = by_class(x, floor)
    near = x.near.select("request_id", "item_id", share("shared").alias("score")).where(F.col("score") >= floor)
    top = plain.select("request_id", "score").union(near.select("request_id", "score")).groupBy("request_id").agg(F.max("score").alias("top"))
    members = of(x.items).select("corpus_id", "held", name).distinct()
    whole = members.join(small(durable(plain.join(top, "request_id").where(kept).drop("top"))), ["corpus_id", "held"]).select("request_id", name, "score")
    one = of(near.join(top, "request_id").where(kept)).select("request_id", name, "score")
    return whole.union(one).groupBy("request_id", name).agg(F.max("score").alias("score"))


def first(x: Overlaps, floor: float, rows: DataFrame, order: list[Column], k: int, group: str | None = None) -> DataFrame:
    """request_id, item_id, score: pairs that hold the k first of each request by score, then `order` over rows (item_id, ...).

    With `group` the first of each value of it counts. Of a class only its k first can be among a request's, and of the
    classes that a kind of request meets only the k first of them all, as an item that is also near only comes earlier.
    """

    def cut(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
        for keys, most in ([([*by, group], 1)] if group else []) + [(by, k)]:
            df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
        return df

    firsts = cut(x.items.join(rows, "item_id"), ["corpus_id", "held"], order)
    met = cut(x.kinds.join(firsts, ["corpus_id", "held"]), ["corpus_id", "wanted"], [F.desc("plain"), *order])
    plain = x.asked.join(met, ["corpus_id", "wanted"]).select("request_id", "item_id", share("plain").alias("score"))
    near = x.near.join(rows.select("item_id"), "item_id", "left_semi").select("request_id", "item_id", share("shared").alias("score"))
    return plain.union(near).where(F.col("score") >= floor).groupBy("request_id", "item_id").agg(F.max("score").alias("score"))


def given(x: Overlaps, pairs: DataFrame) -> DataFrame:
    """(request_id, item_id) -> request_id, corpus_id, item_id, held, plain, score of those of one corpus that share a term."""
    met = pairs.join(x.asked, "request_id").join(x.items, ["corpus_id", "item_id"]).join(x.near.select("request_id", "item_id", "shared"), ["request_id", "item_id"], "left")
    plain = F.size(F.array_intersect("wanted", "held")).cast("long")
    return met.withColumn("plain", plain).withColumn("score", F.coalesce("shared", "plain") / F.col("n")).where("score > 0").select("request_id", "corpus_id", "item_id", "wanted", "n", "held", "plain", "score")


MINUTE, PREFIX = 60_000_000, 4


def places(x: Overlaps, floor: float, asked: DataFrame, rows: DataFrame, by_score: bool) -> DataFrame:
    """request_id, item_id, rank of asked pairs (which reach the floor) in the list of all that do, without putting it in order.

    Lists go by score, then item_id, or by `at` of rows (item_id, a text, and at, in microseconds), then item_id. A place in a
    class is counted by ranges of minutes or of first characters, of which only the pair's own is put in order. Classes take
    near pairs for what their common terms are worth; the difference is added for each.
    """
    pairs = given(x, asked)
    own = F.substring("item_id", 1, PREFIX) if by_score else F.floor(F.col("at") / MINUTE)
    o = F.lit(0).cast("long") if by_score else F.col("at")
    met = pairs.select("request_id", "item_id", "corpus_id", "wanted", "score", "n").join(x.kinds, ["corpus_id", "wanted"]).where(share("plain") >= floor)
    sizes = x.items.groupBy("corpus_id", "held").agg(F.count("*").alias("c"))
    total = pairs.select("request_id", "item_id", F.lit(0).cast("long").alias("c"))
    if by_score:
        total = total.union(met.where(share("plain") > F.col("score")).join(small(sizes), ["corpus_id", "held"]).select("request_id", "item_id", "c"))
        met = met.where(share("plain") == F.col("score"))
    row = ["corpus_id", "held", own.alias("_b"), o.alias("_o"), "item_id"]
    spots = met.join(rows, "item_id").select(*row, "request_id", F.lit(0).alias("_m"))
    both = durable(x.items.join(spots.select("corpus_id", "held").distinct(), ["corpus_id", "held"], "left_semi").join(rows, "item_id").select(*row, F.lit(None).cast(spots.schema["request_id"].dataType).alias("request_id"), F.lit(1).alias("_m")).union(spots))
    before = Window.partitionBy("corpus_id", "held").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = both.groupBy("corpus_id", "held", "_b").agg(F.sum("_m").alias("_s")).select("corpus_id", "held", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("corpus_id", "held", "_b").orderBy("_o", "item_id", "_m").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_in", F.sum("_m").over(inside)).where("_m = 0").join(ranges, ["corpus_id", "held", "_b"])
    total = total.union(placed.select("request_id", "item_id", F.col("_before") + F.col("_in")))
    mine = pairs.select("request_id", "item_id", "score").join(rows, "item_id").select("request_id", "item_id", "score", o.alias("_o"))
    near = x.near.where(share("shared") >= floor).join(rows, "item_id").select("request_id", F.col("item_id").alias("_y"), share("shared").alias("_s"), share("plain").alias("_p"), o.alias("_yo"))
    ahead = (F.col("_yo") < F.col("_o")) | ((F.col("_yo") == F.col("_o")) & (F.col("_y") < F.col("item_id")))
    at = lambda s: ((F.col(s) > F.col("score")) | ((F.col(s) == F.col("score")) & ahead)) if by_score else ahead
    more = at("_s").cast("long") - ((F.col("_p") >= floor) & at("_p")).cast("long")
    total = total.union(mine.join(near, "request_id").select("request_id", "item_id", more))
    return total.groupBy("request_id", "item_id").agg((F.sum("c") + 1).alias("rank"))
