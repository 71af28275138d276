"""Substring dedup by compaction of a sparse De Bruijn graph.

Every window of `window` words has an anchor, the token k-mer of least hash in it; equal windows have equal anchors.
Anchors are the graph's nodes, the words from one anchor to the next its edges (labelled by a hash of those words), and
occurrences keep source coordinates (document, position). Spark joins find the nodes that several documents hold and
whether each has one way in and one way out; runs of them compact into paths, all of whose occurrences hold the same
words. A window inside a path is thereby known to repeat in every document that holds the path. Only windows that reach
over a path's ends are compared one by one, by a 128-bit hash of their words. So long repeated spans cost two short
flanks and copies of whole documents next to nothing.

A word goes where it is in a window whose words also start in a document of smaller doc_id. A null text has no words;
texts under `window` words lose none; rows with a null doc_id lose none and take none. Repeated rows count as one
document and give repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, binary_values, materialize, mix, rows_of, spread_join, words

WINDOW, NODE = 50, 20
BROADCAST_IDS = 1_000_000  # 8 MB; beyond it keys are joined by a shuffle
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.., and the same of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 15)
        inverse = pow(base, -1, 1 << 64)
        _POWERS[base] = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (base, inverse))
    return _POWERS[base]


class Ranges:
    """Hashes of any runs of a document's words, from prefix sums."""

    def __init__(self, h: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(h) + 1)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * up[: len(h)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])


def anchors(r: Ranges, n: int, window: int, node: int) -> np.ndarray:
    """For each window of a document its anchor's position."""
    at = np.arange(n - node + 1)
    h = r.of(at, at + node)
    return np.lib.stride_tricks.sliding_window_view(h, window - node + 1).argmin(axis=1) + np.arange(n - window + 1)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and _key, a hash of the text, name a document: a repeated doc_id with another text is another document."""
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def occurrences(docs: DataFrame, window: int, node: int) -> DataFrame:
    """Every anchor with its coordinates, and the edges in and out (null at a document's ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            ends: list[np.ndarray] = []
            for key, doc, text in zip(keys, ids, binary_values(batch, 2), strict=True):
                ws = words(text)
                if len(ws) < window:
                    continue
                r = Ranges(hashes.array(ws))
                pos = np.unique(anchors(r, len(ws), window, node))
                edge = r.of(pos[:-1], pos[1:] + node) if len(pos) > 1 else np.empty(0, np.uint64)
                gap = np.zeros(1, np.uint64)
                for column, value in zip(out, (np.full(len(pos), key), np.full(len(pos), doc), pos, r.of(pos, pos + node).view(np.int64), np.concatenate((edge, gap)).view(np.int64), np.concatenate((gap, edge)).view(np.int64)), strict=True):
                    column.append(value)
                ends.append(len(pos))
            if ends:
                last = np.cumsum(ends) - 1
                mask_out, mask_in = np.zeros(sum(ends), bool), np.zeros(sum(ends), bool)
                mask_out[last], mask_in[last - np.array(ends) + 1] = True, True
                c = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2].astype(np.int32)), pa.array(c[3]), pa.array(c[4], mask=mask_out), pa.array(c[5], mask=mask_in)], ["_key", "doc_id", "pos", "node", "way_out", "way_in"])

    return docs.where("doc_id is not null").mapInArrow(run, "_key long, doc_id long, pos int, node long, way_out long, way_in long")


def repeated_nodes(found: DataFrame) -> DataFrame:
    """Nodes that several documents hold: the first of them, and whether all occurrences have one way out, one way in."""
    g = found.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), F.count("*").alias("_n"), *[f(w).alias(f"{n}_{w}") for w in ("way_out", "way_in") for n, f in (("min", F.min), ("max", F.max), ("n", F.count))])
    one = lambda w: (F.col(f"min_{w}") == F.col(f"max_{w}")) & (F.col(f"n_{w}") == F.col("_n"))
    return g.where("first < _last").select("node", F.col("_n").alias("n"), "first", F.coalesce(one("way_out"), F.lit(False)).alias("one_out"), F.coalesce(one("way_in"), F.lit(False)).alias("one_in"))


def chosen(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs that have a row in lists (by doc_id and _key), with it; the others are sifted out before any text moves."""
    ids = lists.select("doc_id", "_key")
    if lists.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, ["doc_id", "_key"], "left_semi").join(lists, ["doc_id", "_key"])


def compare_windows(texts: DataFrame, window: int, node: int) -> DataFrame:
    """doc texts with their repeated anchors -> rows (_key, doc_id, start, end, a, b): windows start..end known to repeat
    in an earlier document (a, b null), or one window to be compared by its hash (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                known: list[tuple[int, int, int, int]] = []
                flanks: list[tuple[np.ndarray, ...]] = []
                for key, doc, text, nodes in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binary_values(part, 2), part.column(3).to_pylist(), strict=True):
                    h = hashes.array(words(text))
                    n = len(h)
                    r = Ranges(h)
                    anchor = anchors(r, n, window, node)
                    nodes = sorted({(x["pos"], x["first"], x["one_out"], x["one_in"]) for x in nodes})
                    order = np.unique(anchor)
                    rank = {p: i for i, p in enumerate(order.tolist())}
                    pos = np.array([x[0] for x in nodes])
                    joined = np.array([a[2] and b[3] and rank[b[0]] == rank[a[0]] + 1 for a, b in zip(nodes[:-1], nodes[1:], strict=True)], bool)
                    path = np.concatenate(([0], np.cumsum(~joined)))  # the path of each repeated anchor
                    low = pos[np.searchsorted(path, path, "left")]
                    high = pos[np.searchsorted(path, path, "right") - 1] + node
                    first = np.array([x[1] for x in nodes])
                    of = np.searchsorted(pos, anchor)
                    hit = (of < len(pos)) & (pos[np.minimum(of, len(pos) - 1)] == anchor)
                    start = np.flatnonzero(hit)
                    of = of[start]
                    inside = (start >= low[of]) & (start + window <= high[of])
                    sure = start[inside & (first[of] < doc)]
                    if len(sure):
                        breaks = np.flatnonzero(np.diff(sure) > 1) + 1
                        known += [(key, doc, int(s[0]), int(s[-1])) for s in np.split(sure, breaks)]
                    rest = start[~inside]
                    if len(rest):
                        second = Ranges(h, BASES[1])
                        flanks.append((np.full(len(rest), key), np.full(len(rest), doc), rest, r.of(rest, rest + window).view(np.int64), second.of(rest, rest + window).view(np.int64)))
                names = ["_key", "doc_id", "start", "end", "a", "b"]
                if known:
                    c = [pa.array(x, pa.int64()) for x in zip(*known, strict=True)]
                    yield pa.RecordBatch.from_arrays([*c, pa.nulls(len(known), pa.int64()), pa.nulls(len(known), pa.int64())], names)
                if flanks:
                    k, d, s, a, b = (np.concatenate(x) for x in zip(*flanks, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, d, s, s, a, b)], names)

    return texts.mapInArrow(run, "_key long, doc_id long, start long, end long, a long, b long")


def plain(docs: DataFrame) -> DataFrame:
    """_key, doc_id, n_words and the digest of all words."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [words(t) for t in binary_values(batch, 2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, split), pa.int64()), pa.array([hashlib.sha256(b" ".join(ws)).hexdigest() for ws in split])], ["_key", "doc_id", "n_words", "_whole"])

    return docs.mapInArrow(rows_of(one), "_key long, doc_id long, n_words long, _whole string")


def cut_words(texts: DataFrame, window: int) -> DataFrame:
    """texts with lists of (start, end) windows -> doc_id, _key, n_removed, kept (text of the words that stay)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                removed, kept = [], []
                for text, spans in zip(binary_values(part, 2), part.column(3).to_pylist(), strict=True):
                    ws = words(text)
                    edge = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["end"] + window for s in spans], -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    removed.append(int(len(ws) - stay.sum()))
                    kept.append(b" ".join(w for w, k in zip(ws, stay.tolist(), strict=True) if k))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "_key", "n_removed", "kept"])

    return texts.mapInArrow(run, "doc_id long, _key long, n_removed long, kept string")


def removals(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """keyed docs -> doc_id, _key with windows (list of start, end) whose words are removed."""
    found = materialize(occurrences(docs, window, node))
    nodes = repeated_nodes(found)
    listed = spread_join(found.select("doc_id", "_key", "pos", "node"), nodes, ["node"]).groupBy("doc_id", "_key").agg(F.collect_list(F.struct("pos", "first", "one_out", "one_in")).alias("nodes"))
    listed = materialize(listed)
    texts = chosen(docs, listed).select("_key", "doc_id", "text", "nodes")
    rows = materialize(compare_windows(texts, window, node))
    flanks = rows.where("a is not null")
    first = flanks.groupBy("a", "b").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count("*").alias("n")).where("_first < _last").drop("_last")
    hits = spread_join(flanks, first, ["a", "b"]).where("_first < doc_id").select("doc_id", "_key", "start", "end").union(rows.where("a is null").select("doc_id", "_key", "start", "end"))
    return materialize(hits.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("start", "end")).alias("windows")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_removed, kept_sha256."""
    docs = keyed(docs)
    windows = removals(docs, window, node)
    texts = chosen(docs, windows).select("doc_id", "_key", "text", "windows")
    cut = cut_words(texts, window).select("doc_id", "_key", "n_removed", F.sha2("kept", 256).alias("_kept")).dropDuplicates(["doc_id", "_key"])
    return plain(docs).join(cut, ["doc_id", "_key"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_kept", "_whole").alias("kept_sha256"))
