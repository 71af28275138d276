"""Mixing sources to target weights: balanced sampling by the cube method.

Each source's target is its share of a budget of words, capped at a multiple of its size. A document is taken
floor(target / size of the source) times and once more by a balanced sample: inclusion probabilities move through the
null space of two constraints (documents and words taken), so that both totals stay, until all but two documents of a
group are decided. Groups are (source, bucket) of bounded size; what a round leaves (two documents a group at most) is
the next round's input, until one group a source is left. Its last twelve documents are the landing problem: of all
choices the one nearest to the words expected of them.

Reruns agree: buckets, order and random steps follow hashes of the row alone. A null source is a source of its own,
last in order; a null text has size 0. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_row_struct

WEIGHTS, SHARE, MOST, GROUP, LANDING = (5.0, 2.0, 1.0), 1.5, 2.0, 1024, 10
TINY = 1e-9


def flight(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Moves p (all strictly between 0 and 1) with sum(p) and sum(p * size) kept until at most two entries are open."""
    rng, p, size = random.Random(seed), p.tolist(), size.tolist()
    open_, rest = [], iter(range(len(p)))
    while True:
        while len(open_) < 3 and (i := next(rest, None)) is not None:
            open_.append(i)
        if len(open_) < 3:
            return np.array(p)
        a, b, c = open_
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(open_, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(open_, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(open_, u, strict=True):
            p[i] += step * x
            if p[i] < TINY:
                p[i] = 0.0
            elif p[i] > 1 - TINY:
                p[i] = 1.0
        open_ = [i for i in open_ if 0 < p[i] < 1]


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decides the few open entries: the choice whose words, and then number, are nearest to what was expected."""
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        words = np.abs(choices @ size[at] - (size[at] * p[at]).sum())
        p = p.copy()
        p[at] = choices[np.lexsort((np.abs(choices.sum(axis=1) - p[at].sum()), words))[0]]
    return p


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target: shares of share * all sizes by weight, none above most * source_size.

    Capping and resharing until none is above is one level: the weight at which the budget is used up. Sources stand by
    most * size / weight; before the first uncapped one all are at their cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    repeating = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", repeating).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("_k", F.row_number().over(by_level))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("_k"))).over(whole))
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _fly(last: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_h", "_key", "size"], kind="stable").reset_index(drop=True)
        p, size = part["p"].to_numpy().copy(), part["size"].to_numpy(np.float64)
        at = np.flatnonzero((p > 0) & (p < 1))
        at = at[LANDING:] if last else at  # what is held back lands with what the flight leaves
        if len(at):
            p[at] = flight(size[at], p[at], int(part["_h"].iloc[0]))
        part["p"] = landing(size, p) if last else p
        return part

    return run


def row_key(*columns: str):
    """A 128-bit name (MD5) of a row's values: each is marked null or led by its length, so that no two rows read alike."""
    parts = []
    for c in columns or ("doc_id", "source", "text"):
        value = F.col(f"`{c}`").cast("string")
        parts += [F.coalesce(F.octet_length(value).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(value, F.lit(""))]
    return F.md5(F.concat(*parts))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, each as often as the mix takes it; rows equal in all columns share what was taken of them."""
    taken = cube_mix(docs, named_by=docs.columns, **options).groupBy("_key").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    rows = with_row_struct(docs, row_key(*docs.columns).alias("_key")).groupBy("_key").agg(F.first("_row").alias("_row")).join(taken, "_key")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def cube_mix(docs: DataFrame, group: int = GROUP, named_by: Sequence[str] = (), **shares) -> DataFrame:
    """doc_id, text, source -> doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source,
    copies, and _key, which names the row by these three columns or by those of named_by.
    """
    sized = docs.select(row_key(*named_by).alias("_key"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    sized = materialize(sized)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    # one row a source: a bounded table, whose size Spark itself checks before it broadcasts it
    plan = targets(per.select("source", "source_size"), **shares).join(per.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = materialize(plan.select(F.col("source").alias("_s"), "source_size", "target", "_n"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_r", ratio).withColumn("whole", F.floor(F.col("_r") + TINY)).withColumn("p", F.greatest(F.lit(0.0), F.col("_r") - F.col("whole")))
    rows = rows.withColumn("p", F.when(F.col("p") < TINY, 0.0).otherwise(F.col("p"))).withColumn("_h", F.xxhash64("_key", "size")).withColumn("_b", F.pmod(F.shiftright("_h", 16), F.ceil(F.col("_n") / group)))
    columns = ["_key", "doc_id", "source", "size", "source_size", "target", "whole", "p", "_h", "_n", "_b"]
    schema = "_key string, doc_id long, source string, size long, source_size long, target double, whole long, p double, _h long, _n long, _b long"
    open_ = F.col("p").between(F.lit(TINY), F.lit(1 - TINY))
    state, decided = rows.select(*columns), []
    most = plan.agg(F.max("_n")).first()[0] or 0
    while True:
        last = most <= group
        state = materialize(state.groupBy("source", "_b").applyInPandas(_fly(last), schema))
        if last:
            break
        decided.append(state.where(~open_))
        # what is left, two a group at most, is dealt to fewer groups
        most = -(-most // group) * 2
        left = -(-most // group)
        state = state.where(open_).withColumn("_b", F.pmod("_b", F.least(F.lit(left), F.greatest(F.lit(1), F.ceil(F.ceil(F.col("_n") / group) * 2 / group)))) if left > 1 else F.lit(0).cast("long"))
    for d in decided:
        state = state.unionByName(d)
    copies = F.col("whole") + F.col("p").cast("long")
    return state.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"), "_key")
