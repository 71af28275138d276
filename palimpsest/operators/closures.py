"""Fixpoints by delta joins: closures over shared conflicts, and an order of documents that may depend on each other in circles.

Every round joins only what the last one added, and writes its result durably. Rounds grow with the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.durable import durable


def conflict_closure(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """(request_id, claim_id) and (conflict_id, claim_id) -> request_id, claim_id, round: all claims that a request reaches
    through conflicts that share a claim, with the number of conflicts passed on the shortest way.

    Nulls reach nothing and are left out; repeated rows count once.
    """
    members = durable(members.dropna().distinct())
    seen = delta = durable(seeds.dropna().select("request_id", "claim_id").distinct().withColumn("round", F.lit(0)))
    hit, n = None, 0
    while True:
        n += 1
        found = delta.join(members, "claim_id").select("request_id", "conflict_id").distinct()
        found = durable(found.join(hit, ["request_id", "conflict_id"], "left_anti") if hit is not None else found)
        delta = durable(found.join(members, "conflict_id").select("request_id", "claim_id").distinct().join(seen, ["request_id", "claim_id"], "left_anti").withColumn("round", F.lit(n)))
        if delta.isEmpty():
            return seen
        hit, seen = found if hit is None else hit.union(found), seen.union(delta)


def peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) and distinct (before, after) among them -> id, level: the longest way to a node from one without predecessors;
    null for nodes on a circle or behind one, which are never free."""
    waits = edges.groupBy(F.col("after").alias("id")).agg(F.count("*").alias("n"))
    left = durable(nodes.join(waits, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n")))
    done, level = None, 0
    while True:
        free = durable(left.where("n = 0").select("id", F.lit(level).alias("level")))
        if free.isEmpty():
            rest = left.select("id", F.lit(None).cast("int").alias("level"))
            return rest if done is None else done.unionByName(rest)
        done = free if done is None else done.unionByName(free)
        freed = edges.join(free.select(F.col("id").alias("before")), "before", "left_semi").groupBy(F.col("after").alias("id")).agg(F.count("*").alias("m"))
        left = durable(left.where("n > 0").join(freed, "id", "left").select("id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")))
        level += 1


def spread_least(marks: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """(id, mark) -> id, mark: the least mark of any node from which a node is reached along edges start -> end."""
    now = changed = durable(marks)
    while True:
        sent = changed.join(edges, changed["id"] == edges[start]).groupBy(edges[end].alias("id")).agg(F.min("mark").alias("_sent"))
        step = durable(now.join(sent, "id", "left").withColumn("_less", F.coalesce(F.col("_sent") < F.col("mark"), F.lit(False))).select("id", F.when(F.col("_less"), F.col("_sent")).otherwise(F.col("mark")).alias("mark"), "_less"))
        now, changed = step.drop("_less"), step.where("_less").drop("_less")
        if changed.isEmpty():
            return now


def circles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) and (before, after) -> id, component: strongly connected components, each named by its least id.

    Each round colours nodes by the least id that reaches them; what also reaches that id, inside its colour, is its
    component. The components found go, and the rest is coloured anew.
    """
    done = None
    left = durable(nodes.select("id").distinct())
    while not left.isEmpty():
        inner = durable(edges.join(left.select(F.col("id").alias("before")), "before", "left_semi").join(left.select(F.col("id").alias("after")), "after", "left_semi").select("before", "after"))
        colour = durable(spread_least(left.withColumn("mark", F.col("id")), inner, "before", "after"))
        a, b = colour.select(F.col("id").alias("before"), F.col("mark").alias("_a")), colour.select(F.col("id").alias("after"), F.col("mark").alias("_b"))
        same = durable(inner.join(a, "before").join(b, "after").where("_a = _b").select("before", "after"))
        # back from each colour's own id: within a colour there is no smaller mark to meet
        back = spread_least(colour.select("id", F.when(F.col("id") == F.col("mark"), 0).otherwise(1).alias("mark")), same, "after", "before")
        found = durable(back.where("mark = 0").join(colour.withColumnRenamed("mark", "component"), "id").select("id", "component"))
        done = found if done is None else done.unionByName(found)
        left = durable(left.join(found, "id", "left_anti"))
    return done if done is not None else nodes.select("id", F.col("id").alias("component"))


def ingest_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) and (before, after) -> id, level, component; documents come in the order (level, id).

    A level is the longest way from a document without predecessors. Those on a circle, or behind one, come after all others:
    by the levels of the components they form among themselves (component: its least id; null for the others). Edges of a
    node with itself, of unknown nodes and repeated ones are left out.
    """
    nodes = durable(nodes.select("id").dropna().distinct())
    known = lambda x: nodes.select(F.col("id").alias(x))
    edges = durable(edges.select("before", "after").where("before <> after").distinct().join(known("before"), "before", "left_semi").join(known("after"), "after", "left_semi").select("before", "after"))
    first = durable(peeled(nodes, edges))
    rest = first.where("level is null").select("id")
    if rest.isEmpty():
        return first.withColumn("component", F.lit(None).cast(nodes.schema["id"].dataType))
    inner = edges.join(rest.select(F.col("id").alias("before")), "before", "left_semi").select("before", "after")
    of = durable(circles(rest, inner))
    a, b = of.select(F.col("id").alias("before"), F.col("component").alias("_a")), of.select(F.col("id").alias("after"), F.col("component").alias("_b"))
    between = durable(inner.join(a, "before").join(b, "after").where("_a <> _b").select(F.col("_a").alias("before"), F.col("_b").alias("after")).distinct())
    later = peeled(of.select(F.col("component").alias("id")).distinct(), between).withColumnRenamed("id", "component")
    start = first.agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("_start"))
    behind = of.join(later, "component").join(F.broadcast(start), F.lit(True)).select("id", (F.col("level") + F.col("_start")).alias("level"), "component")  # one row
    return first.where("level is not null").select("id", "level", F.lit(None).cast(nodes.schema["id"].dataType).alias("component")).unionByName(behind)
