"""Helpers shared by the operators: durable intermediate tables, sizing, connected components, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 512
_TEMP: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return _TEMP.setdefault("dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone: the folder's owner then clears it
        pass


_OPEN: list[list[tuple[SparkSession, str]]] = []


def materialize(df: DataFrame, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage in a way that survives lost executors.

    Tables go when the interpreter ends, or before that at the end of `temporary()`, but for those to keep.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_drop, spark, path)
    if _OPEN and not keep:
        _OPEN[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables written inside are deleted at the end: what is to outlive them is materialized with keep."""
    _OPEN.append([])
    try:
        yield
    finally:
        for spark, path in _OPEN.pop():
            _drop(spark, path)


BROADCAST_IDS = 1_000_000  # 8 MB; beyond it ids are joined by a shuffle


def small(ids: DataFrame) -> DataFrame:
    """A table of one id column, marked for broadcast where it has been counted to be small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a whole text column; counts follow it so that a task's share stays the same at every size."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def with_row_struct(docs: DataFrame, *columns) -> DataFrame:
    """All columns packed into _row (so that no name can clash) beside the given working columns."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *columns)


def binary_values(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding."""
    return batch.column(i).cast(pa.large_binary() if pa.types.is_large_string(batch.column(i).type) else pa.binary()).to_pylist()


def words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of bytes other than x20 and x09-x0D; lower changes A-Z only. Null: none."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


class WordHash(dict):
    """word -> 64-bit hash as a signed long, remembered; starts anew beyond a bound, so that memory stays bounded."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def spans_hash(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """A hash of every run of k consecutive word hashes; empty where there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power, done = None, h.copy(), 0
    # doubling: power holds runs of length w, out the run of the k's low bits
    w, bits, factor = 1, k, (2 * salt + 0x5851F42D4C957F2D) | 1
    while bits:
        if bits & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(factor) + part
            done += w
        bits >>= 1
        if bits:
            power = power[:-w] * np.uint64(factor) + power[w:]
            factor, w = factor * factor % (1 << 64), 2 * w
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows, so that Python copies few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def rows_of(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that handles a batch; it gets at most SLICE rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if (out := fn(part)) is not None:
                yield out

    return run


def block_pairs(rows: DataFrame, key: str, item: str, size: str, block: int) -> DataFrame:
    """Deals the members of each key out to blocks of about `block` and repeats them once for each pair of blocks.

    rows has the key's number of members in `size`. Adds lo and hi (the pair of blocks) and own (the member's): members
    of own = lo meet those of own = hi, so that any two members meet in exactly one (key, lo, hi), of bounded size.
    """
    blocks = F.ceil(F.col(size) / block)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(item), blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other")).drop("_other", size)


HEAVY, FEW = 512, 1 << 16  # below FEW rows no key can burden a task


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows joined with table, which has one row per key with the number of the key's rows in `n` (dropped).

    A key with more than a HEAVY-th of all rows would land in one task; there are fewer than HEAVY such keys, so their
    table rows are broadcast and their rows stay where they are. All other keys meet by a shuffle.
    """
    table = materialize(table)
    total = table.agg(F.sum(n)).first()[0] or 0
    heavy = table.where(F.col(n) * HEAVY > total).drop(n)
    if total < FEW or heavy.isEmpty():
        return rows.join(table.drop(n), keys)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(table.where(F.col(n) * HEAVY <= total).drop(n), keys)
    return light.unionByName(rows.join(F.broadcast(heavy), keys))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges -> (id, component): the smallest id that each linked id can reach.

    Alternates large-star and small-star steps; each halves the depth of trees, and each round is written to the
    shared folder. A step groups by key with map-side combining and joins back by spread_join, so that a hub is no task's alone.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(e)
    while before[0]:
        few = before[0] < 4096
        star = (lambda rows, table: rows.join(table.drop("n"), "u")) if few else (lambda rows, table: spread_join(rows, table, ["u"]))
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n"))
        large = star(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if few else materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        starred = star(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        e = materialize(starred)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
