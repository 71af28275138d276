"""Conversation prefix trie by van Emde Boas recursion over depth.

Sequences of turns are cut at half of the greatest depth, the halves at half of theirs, and so on: log2(depth) levels, and
all parts of one level are one Spark job. Going down, a cut prefix takes its name (128 bits) from its part's root and from
the block of turns between them; blocks take theirs from their halves. Once every prefix has a name, one grouping makes
the nodes. Going up, each part's subtree totals stand within its own block of depths: the totals of the lower forests'
tops, summed by the cut node above them, are grafted onto that node and its ancestors inside the upper part, which
doubles the block. So a subtree's total takes log2(depth) grafts, and each of them touches a node at most once per cut
below it; no path is walked turn by turn, and no conversation, hot prefix or node is gathered in one task.

A node is identified by (conv_id, depth), conv_id being its smallest member. Turns are ordered by turn (null first), then
role and text; a null role or text is empty. Rows with a null conv_id belong to no conversation and are left out. Repeated
rows are turns like others. An empty table has no conversation, hence no node. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_values, materialize, slices, spread_join

SYSTEM, MOST = 20, 4  # conversations that borrow from one; turns borrowed are below MOST
CHUNK = 8192  # ids of one end node that a row of its digest's input holds
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> c, d (from 1), a, b (name of role and text), words.

    Rows are dealt by ranges of (conv_id, turn, role, text), so that a long conversation lies in several tasks: each
    numbers its own share, and the shares before it are added. At most one conversation goes on from one range to the next.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")])
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in slices(batches):
            names, words, places, ids = [], [], [], batch.column(0).to_pylist()
            for c, role, text in zip(ids, binary_values(batch, 2), binary_values(batch, 3), strict=True):
                at = at + 1 if c == last else 1
                last = c
                places.append(at)
                names.append(xxhash.xxh3_128_digest(b"%d:%b%b" % (len(role), role, text)))
                words.append(len(text.split()))
            ab = np.frombuffer(b"".join(names), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(places, pa.int64()), pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.array(words, pa.int64())], ["c", "share", "place", "a", "b", "words"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("share", F.spark_partition_id())
    placed = materialize(dealt.mapInArrow(number, "c long, share int, place long, a long, b long, words long"))
    shares = placed.groupBy("c", "share").agg(F.max("place").alias("size"))
    before = F.sum("size").over(Window.partitionBy("c").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    later = shares.withColumn("before", before).where("before is not null").drop("size")  # at most one row a range
    return placed.join(F.broadcast(later), ["c", "share"], "left").select("c", (F.col("place") + F.coalesce("before", F.lit(0))).alias("d"), "a", "b", "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first h turns of conversation c - c % 20, then c's own turns after its first h; h = crc32(c) % 4.

    Returns the rebuilt turns (c, d, a, b, words) and all conversations (c, size), turnless ones with size 0.
    """
    turns = materialize(turns)
    size = turns.groupBy("c").agg(F.max("d").alias("n"))
    own = size.select("c", "n", (F.col("c") - F.col("c") % SYSTEM).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % MOST).alias("h"))
    own = own.join(size.select(F.col("c").alias("base"), F.col("n").alias("most")), "base", "left").withColumn("k", F.least("h", F.coalesce("most", F.lit(0))))
    own = materialize(own.select("c", "n", "base", "h", "k"))
    kept = spread_join(turns, own.select("c", "h", "k", "n"), ["c"]).where("d > h").select("c", (F.col("d") - F.col("h") + F.col("k")).alias("d"), "a", "b", "words")
    lent = turns.where(F.col("d") < MOST).withColumnRenamed("c", "base").join(own.select("c", "base", "k"), "base").where("d <= k").select("c", "d", "a", "b", "words")
    return kept.unionByName(lent), own.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))


def named(*columns: str) -> list:
    """A 128-bit name (a, b) of what the columns hold."""
    return [F.xxhash64(F.lit(seed), *columns).alias(x) for seed, x in ((1, "a"), (2, "b"))]


def prefix_names(turns: DataFrame, conversations: DataFrame, levels: int) -> DataFrame:
    """c, d, a, b of every prefix (d = 0 for the root of all): names from the cuts downwards."""
    blocks = [turns.select("c", (F.col("d") - 1).alias("s"), "a", "b")]
    for _ in range(levels - 1):
        half = lambda x, odd: F.max(F.when(F.col("s") % 2 == odd, F.col(x)))
        pairs = blocks[-1].groupBy("c", F.expr("s div 2").alias("t")).agg(*[half(x, odd).alias(f"{x}{odd}") for odd in (0, 1) for x in "ab"], F.count("*").alias("n")).where("n = 2")
        blocks.append(materialize(pairs.select("c", F.col("t").alias("s"), *named("a0", "b0", "a1", "b1"))))
    names = conversations.select("c", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in reversed(blocks):
        upper = level.where("s % 2 = 0").select("c", F.expr("s div 2").alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
        cut = names.join(upper, ["c", "s"], "left")
        same = F.struct((F.col("s") * 2).alias("s"), "a", "b")
        below = F.when(F.col("x").isNotNull(), F.struct((F.col("s") * 2 + 1).alias("s"), *named("a", "b", "x", "y")))
        names = cut.select("c", F.explode(F.array_compact(F.array(same, below))).alias("p")).select("c", "p.s", "p.a", "p.b")
    return names.withColumnRenamed("s", "d")


def graft(nodes: DataFrame, owners: DataFrame, levels: int) -> DataFrame:
    """nodes with their own n_leaves and saved_tokens -> with those of their subtrees, the root (depth 0) included."""
    totals = [F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")]

    def added(nodes: DataFrame, more: DataFrame) -> DataFrame:
        plus = [(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_leaves", "_leaves"), ("saved_tokens", "_saved"))]
        return nodes.join(more, ["conv_id", "depth"], "left").select(*[c for c in nodes.columns if c not in ("n_leaves", "saved_tokens")], *plus)

    for level in range(levels):
        width = 1 << level
        tops = nodes.where((F.col("depth") > 0) & ((F.col("depth") - 1) % (2 * width) == width))
        cuts = tops.groupBy(F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("cut")).agg(*totals)
        above = cuts.select("c", F.explode(F.sequence(F.col("cut") - (width - 1), F.col("cut"))).alias("d"), "_leaves", "_saved").join(owners, ["c", "d"])
        more = above.groupBy(F.col("owner").alias("conv_id"), F.col("d").alias("depth")).agg(*[F.sum(x).alias(x) for x in ("_leaves", "_saved")])
        nodes = materialize(added(nodes, more))
    first = nodes.where("depth = 1").groupBy(F.col("parent_conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth")).agg(*totals)
    return added(nodes, first)


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, c -> conv_id, depth, ends_sha256 of the ids c in order, comma-joined.

    Ids are put in order by ranges and joined to pieces of CHUNK ids there; an end node's pieces stream through one digest.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "first", "piece"]
        for batch in batches:
            at, depth, c = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((np.diff(at) != 0) | (np.diff(depth) != 0)) + 1
            bounds = [0, *new.tolist(), len(c)]
            cuts = [(x, min(x + CHUNK, high)) for low, high in zip(bounds[:-1], bounds[1:], strict=True) for x in range(low, high, CHUNK)]
            first = [x for x, _ in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(depth[first]), pa.array(c[first]), pa.array([",".join(map(str, c[x:y].tolist())) for x, y in cuts], pa.string())], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, state = ["conv_id", "depth", "ends_sha256"], None, None
        for batch in batches:
            done = []
            for at, depth, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch, 3), strict=True):
                if (at, depth) == key:
                    state.update(b"," + piece)
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (at, depth), hashlib.sha256(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names)

    dealt = ends.select("conv_id", "depth", "c").repartitionByRange("conv_id", "depth", "c").sortWithinPartitions("conv_id", "depth", "c")
    found = dealt.mapInArrow(pieces, "conv_id long, depth long, first long, piece string")
    return found.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(c, d, a, b, words) turns and (c, size) conversations -> conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256: one row a node."""
    turns, conversations = materialize(turns), materialize(conversations)
    levels = max(1, (conversations.agg(F.max("size")).first()[0] or 0).bit_length())  # names reach depth 2^levels - 1
    paths = materialize(prefix_names(turns, conversations, levels))
    found = materialize(paths.groupBy("a", "b").agg(F.min("c").alias("owner"), F.min("d").alias("depth"), F.count("*").alias("n")))
    owners = materialize(spread_join(paths, found.select("a", "b", "owner", "n"), ["a", "b"]).select("c", "d", "owner"))
    nodes = found.select(F.col("owner").alias("conv_id"), "depth", F.col("n").alias("n_convs"))
    nodes = nodes.join(turns.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "words"), ["conv_id", "depth"], "left")
    nodes = materialize(nodes.join(owners.select(F.col("c").alias("conv_id"), (F.col("d") + 1).alias("depth"), F.col("owner").alias("parent_conv_id")), ["conv_id", "depth"], "left"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0).cast("long"))).alias("saved_tokens"))
    totals = graft(materialize(nodes), owners, levels)
    last = conversations.select("c", F.col("size").alias("d")).join(owners, ["c", "d"])
    ends = end_digests(last.select(F.col("owner").alias("conv_id"), F.col("d").alias("depth"), "c"))
    return totals.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> the trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt_turns(numbered_turns(conversations)))
