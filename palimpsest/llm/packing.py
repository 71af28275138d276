"""Packing: harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds the documents of capacity / (k + 1) < length <= capacity / k
tokens, and each of its bins takes k whole documents. What such a bin leaves free is filled by the one kind of document
that has to be cut anyway: documents over the capacity lie in a reservoir, from which whole sequences and the pieces for
the gaps are cut. Documents of the last class (at most capacity / CLASSES tokens) go to the reservoir too. A full bin
waits for the reservoir; where more than WAITING bins wait, a waiting document of the shortest lengths is cut up instead.
Every worker (input partition) does this alone, with no shuffle; it holds at most some capacities of open documents for
each class. What a worker still holds at its end is laid end to end and cut at the capacity, the rest into sequences of
powers of two, which need no padding.

A null or empty text is one end token. Null doc_ids stay null. Repeated rows are packed each. Sequence ids are the
worker's number times 2^40 plus a running number: unique, and equal in reruns over the same input splits.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

CLASSES, WAITING, RESERVE = 64, 32, 8
SPECIAL = {"<|endoftext|>": 50256}  # fixed value: the vocabulary's one special token


class Encoder(dict):
    """Byte-level BPE ids as little-endian 32-bit bytes, remembering the ids of what stands between single spaces.

    A single space between two other visible characters always begins a new unit of the vocabulary's splitting
    pattern, so such units can be encoded apart; texts with other white space around a space are encoded whole. A special
    token's own text stands apart from its neighbours and takes its one id.
    The ids are those of the tokenizers file of the same vocabulary (a test holds them against each other).
    """

    BOUND = 1_500_000

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise KeyError(unit)
        if len(self) >= self.BOUND:
            self.clear()
        ids = self[unit] = array("I", self.plain(" " + unit)).tobytes()
        return ids

    def ordinary(self, text: str) -> bytes:
        first, *units = text.split(" ")
        if units and (not first or first[-1].isspace()):
            return array("I", self.plain(text)).tobytes()
        try:
            return array("I", self.plain(first)).tobytes() + b"".join(map(self.__getitem__, units))
        except KeyError:
            return array("I", self.plain(text)).tobytes()

    def ids(self, text: str) -> bytes:
        for token, number in SPECIAL.items():
            if token in text:
                return array("I", [number]).tobytes().join(map(self.ids, text.split(token)))
        return self.ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks: str) -> Encoder:
    """One for each Python worker, kept across tasks."""
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = Encoder(ranks)
    return _ENCODERS[ranks]


class Document:
    """What is left of a document: its ids from `at` on."""

    __slots__ = ("doc", "ids", "at", "n")

    def __init__(self, doc: int | None, ids: bytes):
        self.doc, self.ids, self.at, self.n = doc, ids, 0, len(ids) // 4

    def left(self) -> int:
        return self.n - self.at

    def take(self, length: int) -> tuple:
        start, self.at = self.at, self.at + length
        return self.doc, start, length, zlib.crc32(memoryview(self.ids)[4 * start : 4 * self.at]), self.n


class Worker:
    """Open bins of one worker: documents go in, rows of full bins come out."""

    def __init__(self, number: int, capacity: int):
        self.next, self.capacity, self.rows = number << 40, capacity, []
        self.classes: dict[int, list[Document]] = {}
        self.reservoir: deque[Document] = deque()
        self.stored = 0
        self.waiting: deque[list[Document]] = deque()  # bins with all their documents and a gap

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def cut(self, length: int) -> list[tuple]:
        """Pieces of `length` tokens in all from the reservoir's front, which has as many."""
        out = []
        self.stored -= length
        while length:
            front = self.reservoir[0]
            n = min(length, front.left())
            out.append(front.take(n))
            length -= n
            if not front.left():
                self.reservoir.popleft()
        return out

    def store(self, document: Document) -> None:
        self.reservoir.append(document)
        self.stored += document.left()

    def add(self, doc: int | None, ids: bytes) -> None:
        document = Document(doc, ids)
        k = self.capacity // document.n
        if k == 0 or k >= CLASSES:
            self.store(document)
        else:
            held = self.classes.setdefault(k, [])
            held.append(document)
            if len(held) == k:
                self.classes[k] = []
                self.waiting.append(held)
        self.settle()

    def settle(self) -> None:
        while self.waiting:
            gap = self.capacity - sum(d.n for d in self.waiting[0])
            while self.stored < gap and len(self.waiting) > WAITING and any(self.classes.values()):
                self.store(self.classes[max(k for k, held in self.classes.items() if held)].pop())
            if self.stored < gap:
                break
            self.close([d.take(d.n) for d in self.waiting.popleft()] + self.cut(gap))
        while self.stored > RESERVE * self.capacity:
            self.close(self.cut(self.capacity))

    def finish(self) -> None:
        for bin_ in self.waiting:  # their gaps are filled from the classes' last documents, as far as these go
            gap = self.capacity - sum(d.n for d in bin_)
            for k in sorted(self.classes, reverse=True):
                while self.stored < gap and self.classes[k]:
                    self.store(self.classes[k].pop())
            if self.stored >= gap:
                self.close([d.take(d.n) for d in bin_] + self.cut(gap))
            else:  # nothing is left to fill it: its documents are laid end to end with the rest
                for document in bin_:
                    self.store(document)
        for held in self.classes.values():
            for document in held:
                self.store(document)
        self.classes, self.waiting = {}, deque()
        while self.stored >= self.capacity:
            self.close(self.cut(self.capacity))
        for i in reversed(range(self.capacity.bit_length())):
            if self.stored >> i & 1:
                self.close(self.cut(1 << i))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def harmonic_pack(docs: DataFrame, ranks: str, capacity: int = 1024, end: int = 0) -> DataFrame:
    """doc_id, text -> one row per piece (SCHEMA). ranks: path of a byte-level BPE rank file that every executor has."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    tail = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).ids
        worker = Worker(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                worker.add(doc, encode(text.as_py() or "") + tail)
                if len(worker.rows) > 20_000:
                    yield worker.batch()
        worker.finish()
        if worker.rows:
            yield worker.batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
