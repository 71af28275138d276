"""LM scoring by Elias-Fano n-gram tries.

Documents become blocks of some megabytes: their tokens as numbers of the block's own words. Each block asks shards of
the model about its distinct (context, word) pairs, once each, and gives the counts of its training documents with the
question. A shard sums the counts of all blocks, builds its part of the trie and answers from it with one quantised code
a pair; so a pair or a context that is in every document reaches a shard once a block, never once a token. Contexts over
a share of all tokens are split among several shards by word. The blocks then score their documents.

A trie's levels: contexts (Elias-Fano over hashes) with monotone pointers to their successors; successors as monotone
numbers relative to their context (Elias-Fano), found by successor search; and for each a code of its discounted
probability (c - D) / N in a codebook of at most 256 values. A level is one flat buffer, read in place through numpy views
(of a memory map as of any other buffer).

The model interpolates absolute discounting: p(w | h) = (c(h, w) - D) / c(h) + D T(h) / c(h) p(w), T(h) the number of
different successors, and p(w) = (c(w) - D) / N, or D / N for a word that training did not see (as many such words are
assumed as were seen). A document starts in a context of its own and ends with an end token.

A null or empty text is its end token alone. A null doc_id counts as text '' for the split. Repeated rows count each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, binary_values, materialize, mix, text_bytes, words

BLOCK_BYTES, SHARD_BYTES, LEAST_SHARDS = 8 << 20, 8 << 20, 8
DISCOUNT, HELD, FOLDS = 0.75, 2, 7
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
WORD_BITS = 40
HOT = 2  # a context over N / (HOT * shards) tokens is split


class EliasFano:
    """A monotone sequence below 2^63 in about 2 + log2(universe / n) bits each, over one flat buffer."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.low_bits, high_bytes = (int(x) for x in np.frombuffer(data, np.int64, 3))
        high = np.unpackbits(np.frombuffer(data, np.uint8, high_bytes, 24), bitorder="little")
        self.high = np.flatnonzero(high) - np.arange(self.n)
        self.low = np.frombuffer(data, np.uint8, offset=24 + high_bytes)

    @staticmethod
    def pack(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        low_bits = min(56, max(0, int(np.floor(np.log2(max(universe, 1) / n))) if n else 0))
        values = values.astype(np.uint64)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        low = b"".join(np.packbits((values[at : at + 65536, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for at in range(0, n, 65536)) if low_bits else b""
        return np.array([n, low_bits, len(high)], np.int64).tobytes() + high + low + bytes(8)

    def get(self, i: np.ndarray) -> np.ndarray:
        value = self.high[i].astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = i * self.low_bits
            word = np.ascontiguousarray(self.low[(bit >> 3)[:, None] + np.arange(8)]).view("<u8")[:, 0]
            value |= word >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)
        return value

    def successor(self, q: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below each q (n: none)."""
        bucket = (q >> np.uint64(self.low_bits)).astype(np.int64)
        at, end = np.searchsorted(self.high, bucket), np.searchsorted(self.high, bucket, "right")
        todo = np.flatnonzero(at < end)
        while len(todo):  # halves what is left of each bucket
            middle = (at[todo] + end[todo]) >> 1
            less = self.get(middle) < q[todo]
            at[todo[less]] = middle[less] + 1
            end[todo[~less]] = middle[~less]
            todo = todo[at[todo] < end[todo]]
        return at


class Trie:
    """Contexts, pointers, successors and codes of one shard."""

    def __init__(self, data: bytes | memoryview):
        sizes = np.frombuffer(data, np.int64, 5)
        at, view, parts = 40, memoryview(data), []
        for size in sizes:
            parts.append(view[at : at + int(size)])
            at += int(size)
        self.contexts, self.pointers, self.successors = map(EliasFano, parts[:3])
        self.codes, self.codebook = np.frombuffer(parts[3], np.uint8), np.frombuffer(parts[4], np.float64)

    @staticmethod
    def pack(contexts: np.ndarray, pointers: np.ndarray, words: np.ndarray, probability: np.ndarray) -> bytes:
        """contexts: sorted 63-bit hashes; pointers: first successor of each and their number; words: sorted in each."""
        of = np.repeat(np.arange(len(contexts)), np.diff(pointers)).astype(np.uint64)
        codebook, codes = quantise(probability)
        parts = [EliasFano.pack(contexts, 1 << 63), EliasFano.pack(pointers, len(words) + 1), EliasFano.pack((of << np.uint64(WORD_BITS)) | words, max(1, len(contexts)) << WORD_BITS), codes.tobytes(), codebook.tobytes()]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)

    def context(self, h: np.ndarray) -> np.ndarray:
        """The number of each context, -1 where it has none."""
        at = self.contexts.successor(h)
        hit = np.flatnonzero(at < self.contexts.n)
        out = np.full(len(h), -1)
        same = hit[self.contexts.get(at[hit]) == h[hit]]
        out[same] = at[same]
        return out

    def width(self, context: np.ndarray) -> np.ndarray:
        """How many successors each context has."""
        known = context >= 0
        out = np.zeros(len(context), np.int64)
        out[known] = (self.pointers.get(context[known] + 1) - self.pointers.get(context[known])).astype(np.int64)
        return out

    def lookup(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Code of each (context, word), 0 where the trie has none: successor search relative to the context."""
        out = np.zeros(len(words), np.uint8)
        known = np.flatnonzero(context >= 0)
        q = (context[known].astype(np.uint64) << np.uint64(WORD_BITS)) | words[known]
        at = self.successors.successor(q)
        hit = np.flatnonzero(at < self.successors.n)
        same = hit[self.successors.get(at[hit]) == q[hit]]
        out[known[same]] = self.codes[at[same]]
        return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codebook with 0 for none first, codes from 1): exact up to 255 different values.

    Beyond that, neighbours share a code where they lie within the least width that 255 codes allow, and take the middle
    of their span: no value is off by more than half that width, and values further apart (the low counts) stay exact.
    """
    values, inverse = np.unique(x, return_inverse=True)
    if len(values) > 255:
        low, high = 0.0, float(values[-1] - values[0])
        while high - low > 1e-6 * high:
            middle = (low + high) / 2
            low, high = (low, middle) if len(spans(values, middle)) <= 255 else (middle, high)
        first = np.array(spans(values, high))
        last = np.append(first[1:], len(values)) - 1
        return np.concatenate(([0], (values[first] + values[last]) / 2)), np.searchsorted(first, inverse, "right").astype(np.uint8)
    return np.concatenate(([0], values)).astype(np.float64), (inverse + 1).astype(np.uint8)


def spans(values: np.ndarray, width: float) -> list[int]:
    """Where each span of sorted values begins that is at most width wide; gives up beyond 255."""
    out, at = [], 0
    while at < len(values) and len(out) <= 255:
        out.append(at)
        at = int(np.searchsorted(values, values[at] + width, "right"))
    return out


def held_out(doc: int | None) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS == HELD


BLOCKS = "block long, docs array<long>, lengths array<int>, held array<boolean>, n_train long, train_docs long, vocab binary, counts binary, tokens binary"


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text -> blocks of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHash(), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[list[bytes]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            lengths = np.array([len(t) + 1 for t in texts], np.int32)
            held = np.array([held_out(d) for d in ids], bool)
            local: dict[bytes, int] = {}
            stream = [local.setdefault(w, len(local)) for t in texts for w in (*t, b"")]
            vocab = hashes.array(list(local)) >> np.uint64(1)
            vocab[local[b""]] = END
            tokens = np.array(stream, np.uint32)
            train = ~np.repeat(held, lengths)
            counts = np.bincount(tokens[train], minlength=len(vocab)).astype(np.uint32)
            row = [number, list(ids), lengths.tolist(), held.tolist(), int(train.sum()), int((~held).sum()), vocab.tobytes(), counts.tobytes(), zlib.compress(tokens.tobytes(), 1)]
            number += 1
            ids.clear()
            texts.clear()
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), binary_values(batch, 1), strict=True):
                ids.append(doc)
                texts.append(words(text, lower=True))
                size += len(text or b"") + 64
                if size >= BLOCK_BYTES:
                    size = 0
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


class Block:
    """The distinct pairs of a block and the shards they belong to; the same for a question and for its answer."""

    def __init__(self, row: dict, shards: int, hot: tuple[np.ndarray, np.ndarray]):
        self.row = row
        self.lengths = np.array(row["lengths"], np.int64)
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.tokens = np.frombuffer(zlib.decompress(row["tokens"]), np.uint32).astype(np.int64)
        v = len(self.vocab)
        before = np.concatenate(([v], self.tokens[:-1]))
        before[np.cumsum(self.lengths) - self.lengths] = v  # the start context
        self.pairs, self.inverse = np.unique(before * v + self.tokens, return_inverse=True)
        self.context, self.word = self.pairs // v, self.pairs % v
        self.names = np.append(self.vocab, START)
        self.context_counts = np.append(self.counts, row["train_docs"]).astype(np.int64)
        self.context_counts[np.flatnonzero(self.vocab == END)] = 0  # nothing follows an end
        at = np.searchsorted(hot[0], self.names)
        at[at == len(hot[0])] = 0
        self.parts = np.where(hot[0][at] == self.names, hot[1][at], 1) if len(hot[0]) else np.ones(v + 1, np.int64)
        part = (mix(self.vocab[self.word]) % self.parts[self.context].astype(np.uint64)).astype(np.int64)
        # a question holds (context, part) heads and, under each, its words; every part of a context is asked
        heads = np.unique(self.context)
        self.head_context = np.repeat(heads, self.parts[heads])
        self.head_part = np.arange(len(self.head_context)) - np.repeat(np.cumsum(self.parts[heads]) - self.parts[heads], self.parts[heads])
        shard = (mix(self.names[self.head_context] + mix(self.head_part.astype(np.uint64))) % np.uint64(shards)).astype(np.int64)
        self.head_order = np.argsort(shard, kind="stable")
        self.head_shard = shard[self.head_order]
        base = np.zeros(v + 2, np.int64)
        base[heads] = np.cumsum(self.parts[heads]) - self.parts[heads]
        head = base[self.context] + part
        place = np.empty(len(shard), np.int64)
        place[self.head_order] = np.arange(len(shard))
        self.pair_order = np.argsort(place[head], kind="stable")
        self.pair_head = place[head][self.pair_order]

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """(shard, heads, pairs) of each question."""
        if not len(self.head_shard):
            return
        edges = np.concatenate(([0], np.flatnonzero(np.diff(self.head_shard)) + 1, [len(self.head_shard)]))
        cuts = np.searchsorted(self.pair_head, edges)
        for i in range(len(edges) - 1):
            yield int(self.head_shard[edges[i]]), slice(edges[i], edges[i + 1]), slice(cuts[i], cuts[i + 1])


def pack40(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8)[:, :5].tobytes() if len(x) else b""


def unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


QUESTIONS = "shard long, block long, heads binary, numbers binary, words binary"


def questions(table: DataFrame, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, shards, hot)
                train = np.repeat(~np.array(row["held"], bool), b.lengths)
                n = np.bincount(b.inverse[train], minlength=len(b.pairs)).astype(np.uint32)[b.pair_order]
                word = (b.vocab[b.word] >> np.uint64(63 - WORD_BITS))[b.pair_order]
                context, part = b.head_context[b.head_order], b.head_part[b.head_order]
                # a context's own count goes with its first part only
                own = np.where(part == 0, b.context_counts[context], 0).astype(np.uint32)
                many = np.bincount(b.pair_head, minlength=len(context)).astype(np.uint32)
                out = [(s, row["block"], b.names[context[h]].tobytes(), zlib.compress(np.concatenate((many[h], own[h], n[p])).tobytes(), 1), pack40(word[p])) for s, h, p in b.slices()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["shard", "block", "heads", "numbers", "words"])

    return table.mapInArrow(run, QUESTIONS)


ANSWERS = "shard long, block long, codes binary, heads binary, codebook binary, seen long, trie_bytes long, successors long"


def answer(total: int):
    """A shard: sums counts, builds its trie, answers every block's question from it."""

    def run(group: pa.Table) -> pa.Table:
        asked = group.to_pylist()
        heads = [np.frombuffer(a["heads"], np.uint64) for a in asked]
        numbers = [np.frombuffer(zlib.decompress(a["numbers"]), np.uint32).astype(np.int64) for a in asked]
        many = [x[: len(h)] for x, h in zip(numbers, heads, strict=True)]
        own = [x[len(h) : 2 * len(h)] for x, h in zip(numbers, heads, strict=True)]
        n = np.concatenate([x[2 * len(h) :] for x, h in zip(numbers, heads, strict=True)])
        word = np.concatenate([unpack40(a["words"]) for a in asked])
        context, of = np.unique(np.concatenate(heads), return_inverse=True)
        count = np.bincount(of, weights=np.concatenate(own), minlength=len(context)).astype(np.int64)
        pair_of = np.repeat(of, np.concatenate(many)).astype(np.uint64)
        pair, inverse = np.unique((pair_of << np.uint64(WORD_BITS)) | word, return_inverse=True)
        c = np.bincount(inverse, weights=n, minlength=len(pair))
        stored = pair[c > 0]
        width = np.bincount((stored >> np.uint64(WORD_BITS)).astype(np.int64), minlength=len(context))
        data = Trie.pack(context, np.concatenate(([0], np.cumsum(width))), stored & np.uint64((1 << WORD_BITS) - 1), np.log10((c[c > 0] - DISCOUNT) / max(total, 1)))
        trie = Trie(data)
        place = trie.context(context)
        codes = trie.lookup(place[(pair >> np.uint64(WORD_BITS)).astype(np.int64)], pair & np.uint64((1 << WORD_BITS) - 1))[inverse]
        width = trie.width(place)
        seen = int(((count > 0) & (context != START)).sum())
        out, at, head = [], 0, 0
        for i, a in enumerate(asked):
            h = of[head : head + len(heads[i])]
            k = int(many[i].sum())
            out.append((a["shard"], a["block"], zlib.compress(codes[at : at + k].tobytes(), 1), zlib.compress(np.concatenate((count[h], width[h])).astype(np.int64).tobytes(), 1), trie.codebook.tobytes(), seen if i == 0 else 0, len(data) if i == 0 else 0, len(stored) if i == 0 else 0))
            at, head = at + k, head + len(h)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ANSWERS.split(", ")])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_raw double, score double"


def scored(total: int, train_docs: int, shards: int, hot: tuple[np.ndarray, np.ndarray]):
    """A block with its answers -> its documents' scores."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        b = Block(row, shards, hot)
        by_shard = {a["shard"]: a for a in answers.to_pylist()}
        v = len(b.vocab)
        seen, width = np.zeros(v + 1, np.int64), np.zeros(v + 1, np.int64)
        direct = np.zeros(len(b.pairs))
        context = b.head_context[b.head_order]
        for shard, heads, pairs in b.slices():
            a = by_shard[shard]
            n = heads.stop - heads.start
            numbers = np.frombuffer(zlib.decompress(a["heads"]), np.int64)
            names, once = np.unique(context[heads], return_index=True)  # parts of a context may share a shard
            seen[names] += numbers[:n][once]
            width[names] += numbers[n:][once]
            codes = np.frombuffer(zlib.decompress(a["codes"]), np.uint8)
            book = np.concatenate(([0.0], 10.0 ** np.frombuffer(a["codebook"], np.float64)[1:].astype(np.float64)))
            direct[b.pair_order[pairs]] = book[codes]
        c = seen[:v].astype(np.float64)
        c[b.vocab == END] = train_docs
        n = max(total, 1)
        single = np.where(c > 0, (c - DISCOUNT) / n, DISCOUNT / n)
        among = np.maximum(seen, 1)[b.context]
        p = np.where(seen[b.context] > 0, direct * n / among + DISCOUNT * width[b.context] / among * single[b.word], single[b.word])
        first = np.cumsum(b.lengths) - b.lengths
        sums = lambda x: np.add.reduceat(x, first)
        columns = [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths), pa.array(sums((c > 0)[b.tokens].astype(np.int64))), pa.array(sums(np.log10(c + 1)[b.tokens])), pa.array(sums(np.log10(p)[b.inverse]))]
        return pa.table(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    table = materialize(blocks(docs))
    total, train_docs = table.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    shards = max(LEAST_SHARDS, -(-text_bytes(docs) // SHARD_BYTES))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vocab, counts, n, starts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                names, c = np.append(np.frombuffer(vocab, np.uint64), START), np.append(np.frombuffer(counts, np.uint32), starts)
                at = np.flatnonzero((c * (2 * HOT * shards) >= max(n, 1)) & (c > 0) & (names != END))
                yield pa.RecordBatch.from_arrays([pa.array(names[at].astype(np.int64)), pa.array(c[at].astype(np.int64))], ["name", "n"])

    # at most 2 * HOT * shards contexts hold such a share of the tokens: the list is bounded by the number of shards
    found = table.select("vocab", "counts", "n_train", "train_docs").mapInArrow(frequent, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") * HOT * shards >= total).orderBy("name").collect()
    hot = np.array([r["name"] for r in found], np.uint64), np.array([min(shards, -(-r["n"] * HOT * shards // max(total, 1))) for r in found], np.int64)
    answers = materialize(questions(table, shards, hot).groupBy("shard").applyInArrow(answer(total), ANSWERS))
    seen = answers.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0] + (1 if train_docs else 0)
    out = table.groupBy("block").cogroup(answers.select("shard", "block", "codes", "heads", "codebook").groupBy("block")).applyInArrow(scored(total, train_docs, shards, hot), SCORES)
    size = float(np.log10(float(total + seen + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base_raw") - F.col("n_tokens") * F.lit(size)).alias("base_score"), "score")
