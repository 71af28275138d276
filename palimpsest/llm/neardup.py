"""MinHash near-dedup by a multi-index Hamming join.

A document is its set of distinct word shingles. Equal sets collapse to one representative (the smallest doc_id). A
representative's signature holds K MinHash values of b = 16 bits, cut into CHUNKS chunks of CHUNK values. By the
pigeonhole principle two signatures that differ in fewer than CHUNKS * (ERRORS + 1) values differ in at most ERRORS
values of some chunk; so a document is indexed under every chunk with every choice of ERRORS values left out, and all
pairs under that distance meet in a bucket (beyond it most still do: at similarity 0.8 a pair is missed about once in
ten million). Candidates are confirmed on their full shingle sets.

A bucket's pairs are never all emitted: first each member meets the bucket's most central one (that which meets most
others over all buckets: the text that copies were made from); then only members of buckets
that still hold several components are compared, in blocks of bounded size: signature against signature, and sets where those allow it. Only
links between different components come out. So no link that joins components is lost.

Rows that share a doc_id are one document: a link of any of its texts is its link, and its texts are linked with each other.
Null, empty or blank texts have no shingles and link with nothing; fewer words than a shingle are one shingle. Rows with
a null doc_id are kept and link with nothing. Repeated rows give repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, binary_values, block_pairs, connected_components, materialize, mix, rows_of, slices, spans_hash, with_row_struct, words

CHUNKS, CHUNK, ERRORS = 12, 5, 1
K = CHUNKS * CHUNK
FARTHEST = 28  # differing values of K beyond which no pair is confirmed: over five deviations from what 0.8 gives
BLOCK, BIN, COLUMNS = 512, 4096, 4096
BROADCAST_IDS = 1_000_000  # 8 MB; beyond it ids are joined by a shuffle
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, K, np.uint64)


def shingle_set(text: bytes | None, size: int, hashes: WordHash, lower: bool = True) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    ws = words(text, lower)
    if not ws:
        return np.empty(0, np.uint64)
    h = hashes.array(ws)
    k = min(size, len(ws))
    return np.unique(spans_hash(h, k, k))


def signature(shingles: np.ndarray) -> np.ndarray:
    """K values of 16 bits."""
    least = np.full(K, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _A + _B).min(axis=0))
    return mix(least).astype(np.uint16)


def sign(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, set_id (null: no shingles), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(batches):
            n, ids, sigs = [], [], []
            for text in binary_values(batch, 1):
                s = shingle_set(text, size, hashes)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_id", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary")


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """A row of keys for each signature: every chunk with every choice of ERRORS values left out."""
    out = []
    for i, kept in itertools.product(range(CHUNKS), itertools.combinations(range(CHUNK), CHUNK - ERRORS)):
        h = np.full(len(sigs), i * 64 + sum(1 << j for j in kept) + 1, np.uint64)
        for j in kept:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, i * CHUNK + j].astype(np.uint64))
        out.append(h)
    return np.stack(out, axis=1)


def matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, K)


def index(reps: DataFrame) -> DataFrame:
    """rep, sig -> (key, rep) rows of the multi-index."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = index_keys(matrix(batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(rows_of(one), "key long, rep long")


def near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) pairs whose set sizes and signatures allow the similarity."""
    one = lambda side: reps.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
    joined = pairs.join(one("a"), "a").join(one("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        differ = (matrix(batch.column(2).to_pylist()) != matrix(batch.column(3).to_pylist())).sum(axis=1)
        return batch.select(["a", "b"]).filter(pa.array(differ <= FARTHEST))

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(rows_of(keep), "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, items): full shingle sets of the documents named in ids (_id). Others are sifted out before any text moves."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, size, hashes).tobytes() for t in binary_values(batch, 1)], pa.binary())], ["id", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string")).join(ids, "_id", "left_semi")
    return materialize(texts.mapInArrow(sets, "id long, items binary").where(F.octet_length("items") > 0))


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) of the pairs whose full shingle sets have 100 * intersection >= percent * union."""
    pairs = materialize(pairs)
    found = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), size)
    joined = pairs.join(found.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    return materialize(joined.select("a", "b", "x", "y").mapInArrow(rows_of(linked), "u long, v long").distinct())


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets left with all sets right: products of incidence matrices, some columns at a time."""
    items, column = np.unique(np.concatenate(left + right), return_inverse=True)
    n = [len(x) for x in left + right]
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(items), COLUMNS):
        s, e = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(n), COLUMNS), np.float32)
        m[row[s:e], column[s:e] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def spanning(labels: np.ndarray) -> list[int]:
    """Numbers of those label pairs that a forest over the labels needs."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out = []
    for i, (a, b) in enumerate(labels.tolist()):
        a, b = root(a), root(b)
        if a != b:
            above[a] = b
            out.append(i)
    return out


def rest_of_buckets(members: DataFrame, components: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) links between components, within buckets that hold several.

    Members that such buckets chain together are a family. Its members meet in pairs of blocks, with their sets; what
    passes the signature threshold is counted out in full there, and a block gives no more links than join its components.
    """
    labelled = members.join(components, members["rep"] == components["id"], "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    labelled = materialize(labelled)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").alias("_n"), F.min("rep").alias("u")).where("_a < _b and _n > 2").select("key", "u")
    family = connected_components(labelled.join(mixed, "key").select("u", F.col("rep").alias("v"))).withColumnRenamed("component", "family")
    family = materialize(family.join(labelled.select(F.col("rep").alias("id"), "label").distinct(), "id"))
    items = sets_of(docs, family.select(F.col("id").alias("_id")), size)
    rows = family.join(reps.select(F.col("rep").alias("id"), "n", "sig"), "id").join(items, "id")
    rows = rows.join(family.groupBy("family").agg(F.count("*").alias("_size")), "family").withColumnRenamed("family", "key")
    rows = materialize(block_pairs(rows, "key", "id", "_size", BLOCK))
    bins = max(1, rows.count() // BIN)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "lo", "hi", "label"], kind="stable")
        group = part[["key", "lo", "hi"]].to_numpy()
        edges = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
        rep, label, n, own = (part[c].to_numpy() for c in ("id", "label", "n", "own"))
        sig, sets = matrix(part["sig"].tolist()), part["items"].tolist()
        u, v = [], []
        for s, e in itertools.pairwise([0, *edges, len(part)]):
            lo, hi = group[s][1:]
            left, right = np.flatnonzero(own[s:e] == lo) + s, np.flatnonzero(own[s:e] == hi) + s
            ok = (label[left][:, None] != label[right][None]) & (100 * np.minimum.outer(n[left], n[right]) >= percent * np.maximum.outer(n[left], n[right]))
            for i in np.flatnonzero(ok.any(axis=1)):
                ok[i] &= (sig[left[i]] != sig[right]).sum(axis=1) <= FARTHEST
            left, right, ok = left[ok.any(axis=1)], right[ok.any(axis=0)], ok[ok.any(axis=1)][:, ok.any(axis=0)]
            if not ok.size:
                continue
            both = intersections([np.frombuffer(sets[i], np.uint64) for i in left], [np.frombuffer(sets[i], np.uint64) for i in right])
            ok &= 100 * both >= percent * (np.add.outer(n[left], n[right]) - both)
            pairs = np.argwhere(ok)
            for i in spanning(np.stack((label[left[pairs[:, 0]]], label[right[pairs[:, 1]]]), axis=1)):
                u.append(rep[left[pairs[i, 0]]])
                v.append(rep[right[pairs[i, 1]]])
        return pd.DataFrame({"u": pd.Series(u, dtype="int64"), "v": pd.Series(v, dtype="int64")})

    binned = rows.withColumn("_bin", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(bins)))
    return materialize(binned.groupBy("_bin").applyInPandas(compare, "u long, v long"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id (smallest doc_id reachable), kept (its own component's name)."""
    signed = materialize(sign(docs, size))
    sets = materialize(signed.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    reps = sets.select("rep", "n", "sig")
    keys = index(reps)
    buckets = keys.groupBy("key").agg(F.min("rep").alias("_near"), F.max("rep").alias("_far"), F.count("*").alias("size")).where("_near < _far").select("key", "size")
    members = materialize(keys.join(buckets, "key"))
    central = members.groupBy("rep").agg(F.sum("size").alias("central"))
    pivots = members.join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("pivot"))
    members = materialize(members.join(pivots, "key"))
    star = members.where("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    links = confirm(near(star, reps, percent), docs, size, percent)
    components = connected_components(links)
    more = rest_of_buckets(members, components, reps, docs, size, percent)
    edges = components.select(F.col("id").alias("u"), F.col("component").alias("v")).union(more)
    several = signed.where("set_id is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("_a"), F.max("set_id").alias("_b")).where("_a < _b").select("doc_id")
    if not several.isEmpty():  # documents of several texts join the representatives of these
        edges = edges.union(signed.join(several, "doc_id").join(sets.select("set_id", "rep"), "set_id").select("doc_id", "rep"))
    components = connected_components(edges)
    by_set = sets.join(components, F.col("rep") == F.col("id"), "left").select(F.col("set_id").alias("_s"), F.coalesce("component", "rep").alias("_c"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(by_set, F.col("set_id") == F.col("_s"), "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, the one of smallest doc_id; of rows equal in doc_id and text, one."""
    found = materialize(near_duplicates(docs, size, percent))
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again"))
    rows = with_row_struct(docs, F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    left = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col("_id") == F.col("_gone"), "left_anti")
    many = again.count()
    if many:
        again = F.broadcast(again) if many <= BROADCAST_IDS else again
        same = F.col("_id") == F.col("_again")
        once = left.join(again, same, "left_semi").groupBy("_id", "_text").agg(F.first("_row").alias("_row"))
        left = left.join(again, same, "left_anti").select("_row").union(once.select("_row"))
    return left.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
