"""Repeated byte strings by longest-previous-factor arrays over suffix order.

A suffix repeats for `window` bytes where its longest previous factor (the longest match with an earlier suffix) is that
long. The match lies at a neighbour in suffix order: the nearest one with a smaller position before or after it. The same
holds for later copies with larger positions; `keep="first"` looks at the former alone, so that first copies stay,
`keep="none"` at both.

Suffixes are not sorted all together. Equal windows have equal anchors (the `node`-gram of least hash in the window), so
only suffixes around anchors that occur twice can repeat; they are put in order bucket by bucket of equal anchors. All
windows of an anchor lie in its surroundings: where a bucket's surroundings are all equal, all repeat, and no text moves.
Otherwise one of each kind is sent: its suffixes are sorted from the right, byte by byte (each suffix order follows from
that of the next start by a stable sort), which orders the suffixes at one start for many buckets at once. Buckets of
more than `LIGHT` kinds are not gathered: their windows fall in eighths, whose whole stretches are counted by hash; only
where kinds of a stretch differ but share the bytes that all its windows have in common are windows spread out and counted.

Texts are UTF-8 bytes, null is empty; rows are documents of their own, whatever their doc_id (null too), so that a
repeated row's text also starts elsewhere; with keep="first" equal rows count as one document and all stay. Texts under
`window` bytes lose nothing. An empty table gives no rows. Only doc_id and text are read: no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices, small, spread_join

WINDOW, NODE = 200, 64
LIGHT, BATCH = 4096, 2048  # kinds in a bucket that is sorted; rows sorted at once
BYTES = 1 << 18  # of text that a task hashes at once
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
EMPTY = hashlib.sha256(b"").hexdigest()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and the same of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 15)
        _POWERS[base] = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[base]


class Runs:
    """Hashes of runs of bytes along the last axis, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        n = data.shape[-1]
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros((*data.shape[:-1], n + 1), np.uint64)
        np.multiply(data + np.uint64(1), up[:n], out=self.sums[..., 1:])
        np.cumsum(self.sums, axis=-1, out=self.sums)

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[..., end] - self.sums[..., start]) * self.down[start])


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of `width` values: the end of one block and the beginning of the next."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    up = np.minimum.accumulate(padded, axis=1).ravel()
    down = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def anchors(runs: Runs, starts: np.ndarray, ends: np.ndarray, window: int, node: int) -> np.ndarray:
    """Positions of the anchors of all windows within the texts starts..ends of one array (the leftmost of equal ones)."""
    at = np.arange(int(ends[-1]) - node + 1)
    packed = (runs.of(at, at + node) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least = window_minima(packed, window - node + 1)
    inside = np.zeros(len(least) + 1, np.int32)
    long = ends - starts >= window
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - window + 1, -1)
    return np.unique((least[np.cumsum(inside[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64))


def groups(texts: list[bytes], limit: int = BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together, one text at least."""
    low = size = 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > limit:
            yield low, i
            low, size = i, 0
        size += len(t)
    if texts:
        yield low, len(texts)


def named(docs: DataFrame) -> DataFrame:
    """doc, key (which name a text), doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)).alias("doc"), F.xxhash64(text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def surroundings(docs: DataFrame, window: int, node: int) -> DataFrame:
    """Every anchor: doc, key, pos, h (names its bytes), t (names its surroundings, cut at the ends of the text)."""
    reach = window - node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs_, keys, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for low, high in groups(texts):
                size = np.fromiter(map(len, texts[low:high]), np.int64, high - low)
                if not (size >= window).any():
                    continue
                ends = np.cumsum(size)
                starts = ends - size
                runs = Runs(np.frombuffer(b"".join(texts[low:high]), np.uint8), BASES[0])
                pos = anchors(runs, starts, ends, window, node)
                of = np.searchsorted(ends, pos, "right")
                lo, hi = np.maximum(starts[of], pos - reach), np.minimum(ends[of], pos + window)
                t = mix(runs.of(lo, hi) ^ ((pos - lo) * 4096 + (hi - pos)).astype(np.uint64))
                columns = (docs_[low:high][of], keys[low:high][of], (pos - starts[of]).astype(np.int32), mix(runs.of(pos, pos + node)).view(np.int64), t.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "key", "pos", "h", "t"])

    return docs.select("doc", "key", "text").mapInArrow(run, "doc long, key long, pos int, h long, t long")


def cut_out(docs: DataFrame, kinds: DataFrame, window: int, node: int) -> DataFrame:
    """kinds (doc, key, pos, h, alone) with their surroundings as `around`: window - node bytes before the anchor, window after it."""
    reach = window - node
    places = materialize(kinds.groupBy("doc", "key").agg(F.collect_set(F.struct("pos", "h", "alone")).alias("places")))
    texts = docs.join(small(places.select("doc", "key")), ["doc", "key"], "left_semi").join(places, ["doc", "key"]).select("doc", "key", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "key", "pos", "h", "alone", "around", "lo", "hi"]
        for batch in slices(batches):
            for doc, key, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                p = [x["pos"] for x in found]
                around = [b"\0" * max(0, reach - x) + text[max(0, x - reach) : x + window] + b"\0" * max(0, x + window - len(text)) for x in p]
                lo, hi = [max(0, reach - x) for x in p], [reach + min(window, len(text) - x) for x in p]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(p)), pa.array([key] * len(p)), pa.array(p, pa.int32()), pa.array([x["h"] for x in found]), pa.array([x["alone"] for x in found]), pa.array(around, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names)

    # repeated rows give one surrounding twice
    return texts.mapInArrow(run, KIND).dropDuplicates(["doc", "key", "pos", "h"])


KIND = "doc long, key long, pos int, h long, alone boolean, around binary, lo int, hi int"


def suffix_order(around: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, rows by their suffixes from start on) for start = first .. 0; each order comes from the one before it."""
    order = np.argsort(np.ascontiguousarray(around[:, first:]).view(f"V{around.shape[1] - first}").ravel(), kind="stable")
    yield first, order
    for start in range(first - 1, -1, -1):
        order = order[np.argsort(around[order, start], kind="stable")]
        yield start, order


def matched_neighbours(place: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order, with equal `run` where they match for a window: whether a matching neighbour, before or
    after, has a smaller place, and whether one has a larger place."""
    span = place.max() + 1
    up = place - run * span  # falls from run to run, so that a running minimum starts anew in each
    down = place + run * span
    new = np.flatnonzero(np.diff(run, prepend=run[:1] - 1))
    size = np.diff(np.append(new, len(run)))
    edge = np.repeat(new, size), np.repeat(new + size - 1, size)
    own = np.arange(len(run))
    before_least, before_most = np.minimum.accumulate(up), np.maximum.accumulate(down)
    after_least = np.minimum.accumulate((place + run * span)[::-1])[::-1]
    after_most = np.maximum.accumulate((place - run * span)[::-1])[::-1]
    back, ahead = np.maximum(own - 1, 0), np.minimum(own + 1, len(run) - 1)
    smaller = (own > edge[0]) & (before_least[back] < up) | (own < edge[1]) & (after_least[ahead] < down)
    larger = (own > edge[0]) & (before_most[back] > down) | (own < edge[1]) & (after_most[ahead] > up)
    return smaller, larger


def starts_of_factors(bucket: np.ndarray, around: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, window: int, node: int, later: bool) -> np.ndarray:
    """(rows, starts) booleans: windows whose longest previous (or, if later, next) factor reaches `window` bytes.

    Only suffixes of one bucket at one start are compared: the anchors of equal windows stand at the same place in them.
    """
    first = window - node
    runs = Runs(around, BASES[1])
    start = np.arange(first + 1)
    name = runs.of(start, start + window)
    found = np.zeros(name.shape, bool)
    for s, order in suffix_order(around, first):
        order = order[(lo[order] <= s) & (s + window <= hi[order])]
        order = order[np.argsort(bucket[order], kind="stable")]
        if len(order) < 2:
            continue
        changes = (np.diff(bucket[order]) != 0) | (np.diff(name[order, s]) != 0)
        smaller, larger = matched_neighbours(place[order], np.concatenate(([0], np.cumsum(changes))))
        found[order, s] = smaller | larger if later else smaller
    return found


def as_runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of each run of true values along the rows."""
    padded = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    change = np.diff(padded, axis=1)
    row, low = np.nonzero(change == 1)
    return row, low, np.nonzero(change == -1)[1] - 1


SPANS = "doc long, key long, lo long, hi long"


def sorted_buckets(kinds: DataFrame, window: int, node: int, later: bool) -> DataFrame:
    """Spans of repeated windows of the kinds in light buckets; whole buckets stream through, BATCH rows together."""
    first, width = window - node, 2 * window - node

    def spans(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, key, pos, h, lo, hi = (part.column(i).to_numpy() for i in (0, 1, 2, 3, 6, 7))
        around = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(-1, width)
        bucket = np.concatenate(([0], np.cumsum(np.diff(h) != 0)))
        place = np.empty(len(doc), np.int64)
        place[np.lexsort((pos, key, doc))] = np.arange(len(doc))
        found = starts_of_factors(bucket, around, lo, hi, place, window, node, later)
        found &= part.column(4).to_numpy(zero_copy_only=False)[:, None]
        row, low, high = as_runs(found)
        base = pos[row].astype(np.int64) - first
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(key[row]), pa.array(base + low), pa.array(base + high + window)], ["doc", "key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, rows
            table = pa.Table.from_batches(waiting).combine_chunks()
            h = table.column("h").to_numpy()
            end = len(h) if last else int(np.flatnonzero(np.diff(h))[-1]) + 1 if (np.diff(h) != 0).any() else 0
            if end:
                yield spans(table.slice(0, end).combine_chunks().to_batches()[0])
            waiting = table.slice(end).to_batches() if end < len(h) else []
            rows = len(h) - end

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                waiting.append(batch.slice(at, BATCH))
                rows += waiting[-1].num_rows
                if rows >= BATCH:
                    yield from whole(False)
        if rows:
            yield from whole(True)

    return kinds.repartition("h").sortWithinPartitions("h").mapInArrow(run, SPANS)


def counted_windows(kinds: DataFrame, window: int, node: int, later: bool) -> DataFrame:
    """Spans of repeated windows of the kinds in heavy buckets, by counting: no bucket is gathered.

    The starts fall in eighths. Stretches of an eighth that are equal throughout repeat as a whole; one of each sort is
    compared further, where another sort shares the bytes (the core) that all windows of the stretch hold.
    """
    first, width = window - node, 2 * window - node
    bounds = np.linspace(0, first + 1, 9).astype(int)
    low, high = bounds[:-1], bounds[1:] - 1
    place = F.struct("doc", "key", "pos")

    def hashes(part: pa.RecordBatch, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        around = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(-1, width)
        h, out = part.column(3).to_numpy()[row].view(np.uint64), []
        for base in BASES:
            runs = Runs(around, base)
            out.append(mix(mix((runs.sums[row, end] - runs.sums[row, start]) * runs.down[start]) ^ mix(h + (start * 4096 + end).astype(np.uint64))).view(np.int64))
        return out

    def given(part: pa.RecordBatch, row: np.ndarray) -> list[np.ndarray]:
        return [part.column(i).to_numpy()[row] for i in range(4)]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                lo, hi = part.column(6).to_numpy(), part.column(7).to_numpy() - window
                s, e = np.maximum(lo[:, None], low), np.minimum(hi[:, None], high)
                row, of = np.nonzero(s <= e)
                s, e = s[row, of], e[row, of]
                columns = [*given(part, row), of.astype(np.int32), s.astype(np.int32), e.astype(np.int32), *hashes(part, row, high[of], low[of] + window), *hashes(part, row, s, e + window)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "key", "pos", "h", "eighth", "s", "e", "a", "b", "x", "y"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH // 8):
                part = batch.slice(at, BATCH // 8)
                found = [(i, x["s"], x["e"], x["alone"]) for i, xs in enumerate(part.column(8).to_pylist()) for x in xs]
                i, s, e, alone = (np.array(c) for c in zip(*found, strict=True))
                size = e - s + 1
                row = np.repeat(i, size)
                start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
                columns = [*given(part, row), np.repeat(alone, size), start.astype(np.int32), *hashes(part, row, start, start + window)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "key", "pos", "h", "alone", "s", "a", "b"])

    def span(start, end):
        base = F.col("pos").cast("long") - first
        return "doc", "key", (base + start).alias("lo"), (base + end + window).alias("hi")

    kinds = materialize(kinds)
    parts = materialize(kinds.mapInArrow(stretches, "doc long, key long, pos int, h long, eighth int, s int, e int, a long, b long, x long, y long"))
    sorts = materialize(parts.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(F.struct("doc", "key", "pos", "h", "s", "e", "a", "b")).alias("at")))
    again = spread_join(parts, sorts.where("n > 1").select("x", "y", "n", F.struct("at.doc", "at.key", "at.pos").alias("least")), ["x", "y"])
    known = (again if later else again.where(place > F.col("least"))).select(*span(F.col("s"), F.col("e")))
    one = sorts.select("at.*", (F.lit(not later) | (F.col("n") == 1)).alias("single"))
    shared = one.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    chosen = spread_join(one, shared, ["a", "b"]).groupBy("doc", "key", "pos", "h").agg(F.collect_set(F.struct("s", "e", F.col("single").alias("alone"))).alias("parts"))
    # a kind that is not alone is known to repeat: it is there for the others
    spread = kinds.join(chosen, ["doc", "key", "pos", "h"]).select(*kinds.columns, "parts")
    found = materialize(spread.mapInArrow(windows, "doc long, key long, pos int, h long, alone boolean, s int, a long, b long"))
    equal = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
    hits = spread_join(found, equal, ["a", "b"])
    hits = hits.where("alone") if later else hits.where(place > F.col("least"))
    return known.unionByName(hits.select(*span(F.col("s"), F.col("s"))))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, node: int = NODE, keep: str = "none", light: int = LIGHT) -> DataFrame:
    """named docs -> doc, key, spans (lo, hi) of bytes whose windows also start elsewhere (keep="none") or earlier ("first")."""
    later = {"none": True, "first": False}[keep]
    around = materialize(surroundings(docs, window, node))
    buckets = around.groupBy("h").agg(F.count("*").alias("n"), F.min("t").alias("least"), F.max("t").alias("most")).where("n > 1")
    found = materialize(spread_join(around, buckets.select("h", "n", (F.col("least") != F.col("most")).alias("mixed")), ["h"]))
    place = F.struct("doc", "key", "pos")
    kinds = materialize(found.where(F.col("mixed") | F.lit(not later)).groupBy("h", "t").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.max("mixed").alias("mixed")))
    # a kind that occurs twice repeats as a whole
    again = spread_join(found.where(F.col("mixed") | F.lit(not later)), kinds.where("n > 1").select("h", "t", "n", "at"), ["h", "t"])
    known = again.drop("at").unionByName(found.where("not mixed")) if later else again.where(place > F.col("at"))
    at = F.col("pos").cast("long")
    spans = [known.select("doc", "key", (at - (window - node)).alias("lo"), (at + window).alias("hi"))]
    mixed = kinds.where("mixed").select("h", "at.doc", "at.key", "at.pos", (F.lit(not later) | (F.col("n") == 1)).alias("alone"))
    sizes = materialize(mixed.groupBy("h").agg(F.count("*").alias("n")))
    heavy = materialize(sizes.where(F.col("n") > light).select("h"))
    texts = cut_out(docs, mixed, window, node)
    if heavy.isEmpty():
        spans.append(sorted_buckets(texts, window, node, later))
    else:
        texts = materialize(texts)
        spans.append(sorted_buckets(texts.join(small(heavy), "h", "left_anti").select(*texts.columns), window, node, later))
        spans.append(counted_windows(texts.join(small(heavy), "h", "left_semi").select(*texts.columns), window, node, later))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return materialize(every.groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))


def merged(rows: DataFrame) -> DataFrame:
    """doc, key, doc_id, n_bytes, _all, spans (null: none) -> runs (maximal removed runs lo, hi), n_removed, n_spans for spans."""
    names = ["doc", "key", "doc_id", "n_bytes", "_all", "runs", "n_removed", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total = [], []
            for found, n in zip(batch.column(5).to_pylist(), batch.column(3).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for lo, hi in sorted((max(0, x["lo"]), min(n, x["hi"])) for x in found or ()):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(hi, runs[-1][1])
                    else:
                        runs.append([lo, hi])
                out.append([{"lo": a, "hi": b} for a, b in runs])
                total.append(sum(b - a for a, b in runs))
            runs_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, runs_type), pa.array(total, pa.int64()), pa.array(map(len, out), pa.int64())], names)

    columns = ["doc", "key", "doc_id", "n_bytes", "_all", "spans"]
    return rows.select(columns).mapInArrow(run, "doc long, key long, doc_id long, n_bytes long, _all string, runs array<struct<lo:long,hi:long>>, n_removed long, n_spans long")


def without(texts: DataFrame) -> DataFrame:
    """doc, key, text, runs -> doc, key, kept (the remaining bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                kept = []
                for text, runs in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    ends = [0, *[x["hi"] for x in runs]]
                    starts = [*[x["lo"] for x in runs], len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(kept, pa.binary())], ["doc", "key", "kept"])

    return texts.mapInArrow(run, "doc long, key long, kept binary")


def repeated_bytes(docs: DataFrame, window: int = WINDOW, node: int = NODE, keep: str = "none", light: int = LIGHT) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and runs (lo, hi), the bytes removed."""
    docs = named(docs)
    spans = repeated_ranges(docs, window, node, keep, light)
    whole = docs.select("doc", "key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_all"))
    sized = materialize(merged(whole.join(spans, ["doc", "key"], "left")))
    # the bytes of a text that goes as a whole need not be fetched; repeated rows are cut once
    part = materialize(sized.where("0 < n_removed and n_removed < n_bytes").select("doc", "key", "runs").dropDuplicates(["doc", "key"]))
    texts = docs.join(small(part.select("doc", "key")), ["doc", "key"], "left_semi").join(part, ["doc", "key"]).select("doc", "key", "text", "runs")
    digests = without(texts).select("doc", "key", F.sha2("kept", 256).alias("_kept")).dropDuplicates(["doc", "key"])
    gone = (F.col("n_removed") == F.col("n_bytes")) & (F.col("n_bytes") > 0)
    return sized.join(digests, ["doc", "key"], "left").select("doc_id", "n_bytes", "n_removed", "n_spans", F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("_kept", "_all")).alias("kept_sha256"), "runs")
