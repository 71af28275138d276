"""Media columns: ISO media containers.

`store_payload` wraps bytes as an 8-bit PCM track (ftyp, moov, mdat); `describe` walks the nested boxes of any ISO
file, decodes its sample tables and gives codec, duration and the byte ranges of sync samples. Payloads are located,
never decoded. Each row is handled alone: no shuffle, and memory is that of one Arrow batch.

Null or empty bytes describe as a null struct; a null text is stored as an empty one; a damaged file gives null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, rows_of

RATE, CHUNK = 8000, 4096
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
INFO = "codec string, timescale long, duration long, samples long, chunks long, bytes long, keyframes array<struct<start:long,end:long>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(text: bytes | None) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def store_payload(payload: bytes) -> bytes:
    """An ISO file with one track of unsigned 8-bit samples; each chunk begins with a sync sample."""
    n, chunks = len(payload), -(-len(payload) // CHUNK)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    firsts = np.arange(chunks, dtype=">u4")
    full_chunks, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK, 1)] if full_chunks else []) + ([(full_chunks + 1, rest, 1)] if rest else [])

    def moov(at: int) -> bytes:
        offsets = (firsts * CHUNK + at).astype(">u8")
        wide = at + n >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", chunks), (firsts * CHUNK + 1).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", 1, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.tobytes() if wide else offsets.astype(">u4").tobytes()),
        )
        data = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), box(b"minf", full(b"smhd", bytes(4)), data, table))
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), matrix, bytes(8), flags=3), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), track)

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    return b"".join((head, moov(len(head) + len(moov(0)) + 8), struct.pack(">I4s", n + 8, b"mdat") if n + 8 < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", n + 16), payload))


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of every box, containers before what they hold, however deep."""
    ends = [end]
    while ends:
        if start + 8 > ends[-1]:
            start = ends.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or ends[-1] - start
        if size < head or start + size > ends[-1]:
            raise ValueError(f"box {kind!r} at {start} leaves its container")
        yield kind, start + head, start + size
        if kind in CONTAINERS:
            ends.append(start + size)
            start += head
        else:
            start += size


def track_tables(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """The boxes of each track, by kind."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for kind, start, end in walk(memoryview(data), 0, len(data)):
        if kind == b"trak":
            tracks.append({})
        elif tracks:
            tracks[-1].setdefault(kind, (start, end))
    return [t for t in tracks if b"stsd" in t and (b"stco" in t or b"co64" in t)]


def sample_table(data: bytes, t: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunk offsets, samples per chunk, first sample of each chunk, sample sizes (one value when constant), sync samples."""
    wide = b"co64" in t
    at = t[b"co64" if wide else b"stco"][0]
    chunks = np.frombuffer(data, ">u8" if wide else ">u4", struct.unpack_from(">I", data, at + 4)[0], at + 8).astype(np.int64)
    at = t[b"stsc"][0]
    runs = np.frombuffer(data, ">u4", 3 * struct.unpack_from(">I", data, at + 4)[0], at + 8).reshape(-1, 3).astype(np.int64)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks)))) if len(runs) else np.zeros(0, np.int64)
    first = np.cumsum(per) - per
    at = t[b"stsz"][0]
    fixed, count = struct.unpack_from(">II", data, at + 4)
    sizes = np.array([fixed], np.int64) if fixed else np.frombuffer(data, ">u4", count, at + 12).astype(np.int64)
    if b"stss" in t:
        at = t[b"stss"][0]
        sync = np.frombuffer(data, ">u4", struct.unpack_from(">I", data, at + 4)[0], at + 8).astype(np.int64) - 1
    else:
        sync = np.arange(count)
    return chunks, per, first, sizes, sync


def chunk_ends(chunks: np.ndarray, per: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if len(sizes) == 1:
        return chunks + per * sizes[0]
    total = np.concatenate(([0], np.cumsum(sizes)))
    return chunks + total[first + per] - total[first]


def describe(data: bytes | None) -> dict | None:
    """Codec, duration, counts and the byte range of each sync sample, for the first track; None if damaged."""
    if not data:
        return None
    try:
        t = next(iter(track_tables(data)), None)
        if t is None:
            return None
        codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
        at = t[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        chunks, per, first, sizes, sync = sample_table(data, t)
        of = np.searchsorted(first, sync, "right") - 1
        total = None if len(sizes) == 1 else np.concatenate(([0], np.cumsum(sizes)))
        start = chunks[of] + ((sync - first[of]) * sizes[0] if total is None else total[sync] - total[first[of]])
        end = start + (sizes[0] if total is None else sizes[sync])
        n = int(per.sum())
        return {"codec": codec, "timescale": scale, "duration": duration, "samples": n, "chunks": len(chunks), "bytes": int(n * sizes[0] if total is None else total[-1]), "keyframes": [{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)]}
    except (ValueError, KeyError, IndexError, struct.error):
        return None


def read_payload(data: bytes) -> bytes:
    """The stored samples of the first track, chunk by chunk, found through the tables."""
    chunks, per, first, sizes, _ = sample_table(data, track_tables(data)[0])
    return b"".join(data[a:b] for a, b in zip(chunks, chunk_ends(chunks, per, first, sizes), strict=True))


def describe_media(df: DataFrame, column: str = "media", name: str = "media_info") -> DataFrame:
    """df with a struct of INFO for each ISO file of a binary column; all other columns stay."""
    kind = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("chunks", pa.int64()), ("bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    at = df.columns.index(column)
    fields = [f for f in df.schema.fields if f.name != name]
    names = [f.name for f in fields]
    keep = [df.columns.index(n) for n in names]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array([describe(x) for x in batch.column(at).to_pylist()], kind)], [*names, name])

    from pyspark.sql.types import StructType, _parse_datatype_string

    return df.mapInArrow(rows_of(one), StructType([*fields]).add(name, _parse_datatype_string(INFO)))


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as the payload of an ISO file (null: an empty text)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in binary_values(batch, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([store_payload(pad(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows_of(one), "doc_id long, n_bytes long, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: digests of what is read back from each stored document, and its container's features."""
    described = describe_media(store_documents(docs))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for data, info in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            payload = read_payload(data)
            keys = ",".join(f"{k['start']}-{k['end']}" for k in info["keyframes"])
            feature = f"codec={info['codec'].strip()};timescale={info['timescale']};duration={info['duration']};samples={info['samples']};chunks={info['chunks']};keyframes={keys}"
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return described.mapInArrow(rows_of(one), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
