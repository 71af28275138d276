"""Filter interaction audit: what each filter removes under every order of applying them.

One pass over the texts gives each document its mask of failed filters. A removal step depends on the mask alone, so
documents are counted by (part, mask, labels) first, with map-side combining. The mask matrix (0 where a filter fails,
infinity elsewhere) and the position matrix of all orders (each order's inverse permutation) then combine by the
min-plus product into the removal step of every mask under every order; counts are scattered to these steps by weight.

A copy (filter E) is a document whose text a smaller doc_id has as well; texts are named by 128 bits of their bytes and
counted by (text, doc_id), so that a hot text is joined without being gathered.

A null text is empty, and so equals an empty one. A null source is the part of the empty source. A document with a null
doc_id is never a copy, makes none and has no labels; repeated rows count each, and are not copies of each other, as no
doc_id is smaller. Several labels of one doc_id count once: any quality or toxic of 1. Null labels are no labels. An
empty table has no parts, hence no rows. Only doc_id, text, source and doc_id, quality, toxic are read: no other column
can clash.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, materialize, rows_of, spread_join

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2  # words; percent of words; percent of code points
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITAL, HEAD = (bytes(b for b in range(256) if not drop(b)) for drop in (lambda b: 65 <= b <= 90, lambda b: b & 0xC0 != 0x80))
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes) -> int:
    """Bit i is set where the text alone fails the i-th filter (A to D)."""
    words = text.split()
    n = len(words)
    capitals, points = len(text.translate(None, CAPITAL)), len(text.translate(None, HEAD))
    return (n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | (SYMBOLS.search(text) is not None) << 3


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of the filters A to D, and the text's name (a, b)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask, names = [], []
        for text in binary_values(batch, 2):
            mask.append(failures(text or b""))
            names.append(xxhash.xxh3_128_digest(text or b""))
        ab = np.frombuffer(b"".join(names), ">i8").reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask, pa.int32()), pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["doc_id", "part", "mask", "a", "b"])

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    return columns.mapInArrow(rows_of(one), "doc_id long, part string, mask int, a long, b long")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), good, toxic, n: the documents of each kind."""
    rows = materialize(marked(docs).groupBy("a", "b", "part", "mask", "doc_id").agg(F.count("*").alias("c")))
    texts = rows.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    copied = texts.where("least < most").drop("most")
    name = spread_join(rows.where("doc_id is not null").select("a", "b", "doc_id"), copied, ["a", "b"]).where("doc_id > least").select("a", "b", "doc_id").distinct()
    flags = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null and (good or toxic)")
    flags = flags.groupBy("doc_id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    # one row a document and none with a null id: no key is hot in these joins
    known = rows.where("doc_id is not null").join(name.withColumn("e", F.lit(1 << FILTERS.index("E"))), ["a", "b", "doc_id"], "left").join(flags, "doc_id", "left")
    columns = ["part", (F.col("mask").bitwiseOR(F.coalesce("e", F.lit(0)))).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "c"]
    unknown = rows.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "c")
    return known.select(*columns).unionByName(unknown).groupBy("part", "mask", "good", "toxic").agg(F.sum("c").alias("n"))


def removal_steps(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders; the step at which each order has each filter; the step that removes each mask (infinity: none)."""
    orders = list(permutations(range(filters)))
    at = np.argsort(np.array(orders), axis=1) + 1.0  # the inverse permutation of each order
    failed = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1 == 1
    zero_or_never = np.where(failed, 0.0, np.inf)
    step = np.full((1 << filters, len(orders)), np.inf)
    for f in range(filters):  # the min-plus product, filter by filter
        np.minimum(step, zero_or_never[:, f, None] + at[None, :, f], out=step)
    return orders, at, step


def order_effects(counts: pd.DataFrame, letters: str = FILTERS) -> pd.DataFrame:
    """Counts of one part by (mask, good, toxic), at most 4 * 2^filters rows -> one row an order and step."""
    k = len(letters)
    orders, at, step = removal_steps(k)
    size = (len(orders), k + 2)  # the last column takes what no filter removes
    weigh = lambda chosen: np.bincount(counts["mask"], counts["n"] * chosen, 1 << k)
    column = np.where(np.isinf(step), k + 1, step).astype(int)
    order = np.broadcast_to(np.arange(len(orders)), column.shape)

    def scatter(weight: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        np.add.at(out, (order, column), weight[:, None])
        return out[:, 1 : k + 1]

    n = weigh(np.ones(len(counts)))
    removed = scatter(n)
    fails = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1 == 1
    failing = n @ fails  # documents that fail each filter
    alone = n[1 << np.arange(k)]
    shapley = np.zeros(k)
    filter_at = np.array(orders)
    np.add.at(shapley, filter_at, removed)
    redundant = failing[filter_at] - removed
    kept = n.sum() - np.cumsum(removed, axis=1)
    good, toxic = scatter(weigh(counts["good"].to_numpy())), scatter(weigh(counts["toxic"].to_numpy()))
    flat = {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": alone[filter_at], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[filter_at]}
    names = ["".join(letters[f] for f in o) for o in orders]
    return pd.DataFrame({"filter_order": np.repeat(names, k), "step": np.tile(np.arange(1, k + 1), len(orders)).astype(np.int32)} | {c: np.rint(v).astype(np.int64).ravel() for c, v in flat.items()})


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, source and doc_id, quality, toxic -> one row per part, order of the filters and step (STEPS)."""

    def run(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        out = order_effects(counts)
        out.insert(0, "part", key[0])
        return out

    return masks(docs, labels).groupBy("part").applyInPandas(run, STEPS)
