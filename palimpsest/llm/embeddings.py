"""Embedding near-dedup by NN-descent.

Equal vectors collapse to one representative. A neighbour graph starts from random hyperplane buckets and is refined by
rounds of neighbours-of-neighbours joins: at each pivot all its neighbours, forward and reverse, meet, and what beats a
vector's worst neighbour joins its list. Edges at or over the threshold link components. A bounded sample of vectors is
held against all others by brute force after each round; while a lower bound on the mean share that a linked vector has of
its own links is below `recall`, another round runs with longer lists. Where `rounds` rounds do not meet it, all vectors
are compared in pairs of blocks, which loses nothing and is quadratic. Lists that may be saturated by links are then enlarged to the whole component: its vectors
meet in pairs of blocks of bounded size, which counts every link inside it in double precision.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do those of different length.
Rows with a null vec_id are kept and link with nothing. Repeated vec_ids count as separate vectors of one name:
distinct vectors are told apart by a hash of the vector (checked for collisions), and names come back at the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, materialize, rows_of, slices, spread_join
from .neardup import spanning

TREES, LEAF, NEIGHBOURS, ROUNDS = 6, 512, 8, 5
BLOCK, BIN = 1024, 8192
AUDIT, MOST, RECALL, Z = 4096, 16384, 0.995, 1.645
MISS = 0.003  # share of pairs at the threshold that may meet in no tree
EXACT_BLOCK, STEP = 4096, 256
STATE = "id long, dim long, vec binary, ids array<long>, sims array<double>"


def unit_vectors(df: DataFrame) -> DataFrame:
    """vec_id, embedding -> vec_id, dim, vec (unit vector as doubles; null where it links with nothing)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, vecs = [], []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = None
            if key is not None and value.is_valid and value.values.null_count == 0 and len(value.values):
                x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                scale = np.abs(x).max()
                if np.isfinite(scale) and scale > 0:
                    x = x / scale
                    v = (x / np.sqrt(x @ x)).tobytes()
            vecs.append(v)
            dims.append(len(v) // 8 if v else 0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "vec"])

    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(rows_of(one), "vec_id long, dim long, vec binary")


def matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest."""
    return np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k] if sims.shape[1] > k else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


def groups(part: pd.DataFrame, columns: list[str]) -> Iterator[pd.DataFrame]:
    part = part.sort_values(columns, kind="stable").reset_index(drop=True)
    keys = part[columns].to_numpy()
    edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    for s, e in itertools.pairwise([0, *edges, len(part)]):
        yield part.iloc[s:e]


def meet(k: int):
    """Members of each (key, lo, hi) meet; what beats a member's worst neighbour comes out, k at most."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out_id, out_ids, out_sims = [], [], []
        for g in groups(part, ["key", "lo", "hi"]):
            own, ids, worst = g["own"].to_numpy(), g["id"].to_numpy(), g["worst"].to_numpy()
            v = matrix(g["vec"].tolist())
            lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
            for rows, columns in [(own == lo, own == hi)] + ([(own == hi, own == lo)] if lo != hi else []):
                r, c = np.flatnonzero(rows), np.flatnonzero(columns)
                if not len(r) or not len(c):
                    continue
                sims = v[r] @ v[c].T
                sims[ids[r][:, None] == ids[c][None]] = -2
                top = best(sims, k)
                s = np.take_along_axis(sims, top, axis=1)
                for i, row in enumerate(r):
                    good = s[i] > worst[row]
                    if good.any():
                        out_id.append(ids[row])
                        out_ids.append(ids[c][top[i][good]])
                        out_sims.append(s[i][good])
        return pd.DataFrame({"id": pd.Series(out_id, dtype="int64"), "ids": out_ids, "sims": out_sims})

    return run


def binned(rows: DataFrame, fn, schema: str) -> DataFrame:
    """Whole (key, lo, hi) groups, about BIN rows to a task's group."""
    rows = materialize(rows)
    bins = max(1, rows.count() // BIN)
    return rows.withColumn("_bin", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(bins))).groupBy("_bin").applyInPandas(fn, schema)


def merged(state: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Lists of state (id, dim, vec, ids, sims) with what was found, cut to the k nearest."""
    rows = found.groupBy("id").agg(F.flatten(F.collect_list("ids")).alias("new_ids"), F.flatten(F.collect_list("sims")).alias("new_sims"))
    joined = state.join(rows, "id", "left")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sims = [], []
        for a, s, b, t in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True):
            near = dict(zip([*a, *(b or ())], [*s, *(t or ())], strict=True))
            top = sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k]
            ids.append([x[0] for x in top])
            sims.append([x[1] for x in top])
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], ["id", "dim", "vec", "ids", "sims"])

    return materialize(joined.select("id", "dim", "vec", "ids", "sims", "new_ids", "new_sims").mapInArrow(rows_of(one), STATE))


def worst(k: int):
    return F.when(F.size("ids") >= k, F.array_min("sims")).otherwise(F.lit(-2.0))


def trees_for(bits: int, threshold: float) -> int:
    """Sets of hyperplanes after which a pair at the threshold has shared no cell in a share MISS of cases."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return max(TREES, int(np.ceil(np.log(MISS) / np.log1p(-together)))) if 0 < together < 1 else TREES


def first_graph(reps: DataFrame, k: int, threshold: float) -> DataFrame:
    """Neighbour lists from the buckets of sets of random hyperplanes, more of them the deeper they are."""
    state = reps.select("id", "dim", "vec", F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("sims"))
    n = reps.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    trees = trees_for(bits, threshold)

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column(1).to_numpy()
        key = np.zeros((batch.num_rows, trees), np.int64)
        vecs = batch.column(2).to_pylist()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            planes = np.random.default_rng(int(dim)).standard_normal((int(dim), trees * max(bits, 1)))
            side = (matrix([vecs[i] for i in at]) @ planes > 0).reshape(len(at), trees, -1)[:, :, :bits]
            key[at] = (side * (1 << np.arange(bits))).sum(axis=2) + (np.arange(trees) << 32) + (int(dim) << 40)
        t = pa.array(np.repeat(np.arange(batch.num_rows), trees))
        return pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column(0).take(t), batch.column(2).take(t)], ["key", "id", "vec"])

    rows = reps.select("id", "dim", "vec").mapInArrow(rows_of(cells), "key long, id long, vec binary").withColumn("worst", F.lit(-2.0))
    size = rows.groupBy("key").agg(F.count("*").alias("size"))
    # a cell over a block's size is dealt to blocks that stay apart, others in each tree: the rounds that follow join what they share
    rows = rows.join(size, "key").withColumn("lo", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("size") / BLOCK))).withColumns({"hi": F.col("lo"), "own": F.col("lo")}).drop("size")
    return merged(state, binned(rows, meet(k), "id long, ids array<long>, sims array<double>"), k)


def descend(state: DataFrame, k: int) -> DataFrame:
    """One round: at each pivot its forward and reverse neighbours meet."""
    forward = state.select(F.col("id").alias("key"), F.explode("ids").alias("id"))
    pairs = forward.union(forward.select("id", "key")).union(state.select("id", "id")).toDF("key", "id").distinct()
    size = pairs.groupBy("key").agg(F.count("*").alias("size"))
    rows = pairs.join(size, "key").join(state.select("id", "vec", worst(k).alias("worst")), "id")
    return merged(state, binned(block_pairs(rows, "key", "id", "size", BLOCK), meet(k), "id long, ids array<long>, sims array<double>"), k)


def lower_bound(shares: np.ndarray) -> float:
    """Wilson's one-sided bound on the mean of shares in [0, 1] (no such variable varies more than a binomial one)."""
    m = len(shares)
    if not m:
        return 0.0
    p, z = float(shares.mean()), Z * Z / m
    return (p + z / 2 - Z * np.sqrt(p * (1 - p) / m + z / (4 * m))) / (1 + z)


def audit(placed: DataFrame, threshold: float, recall: float = RECALL, size: int = AUDIT, most: int = MOST) -> tuple[float, float]:
    """The mean share of its own links that a sampled vector with links has in its component, and a lower bound on it.

    The sample grows to `most` where it holds too few linked vectors for the bound to reach `recall` at all.
    """
    n = placed.count()
    shares = link_shares(placed, threshold, size)
    while lower_bound(np.ones(len(shares))) < recall and size < min(n, most):
        size = min(4 * size, most)
        shares = link_shares(placed, threshold, size)
    mean = float(shares.mean()) if len(shares) else 1.0
    return mean, mean if size >= n else lower_bound(shares)


def link_shares(placed: DataFrame, threshold: float, size: int) -> np.ndarray:
    """Of each of `size` vectors that has links, by brute force: the share of them whose ends are in one component."""
    sample = placed.orderBy(F.xxhash64("id"), "id").limit(size).select("id", "dim", "vec", "component").collect()
    by_dim = {d: ([r for r in sample if r["dim"] == d]) for d in {r["dim"] for r in sample}}
    tables = {d: (np.array([r["id"] for r in rs]), np.array([r["component"] for r in rs]), matrix([bytes(r["vec"]) for r in rs])) for d, rs in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = ({d: np.zeros(len(q), np.int64) for d, (q, _, _) in tables.items()} for _ in range(2))
        for batch in slices(batches):
            dims, ids, comps, vecs = batch.column(1).to_numpy(), batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(2).to_pylist()
            for d, (q, qc, qv) in tables.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    link = (qv @ matrix([vecs[i] for i in at]).T >= threshold) & (q[:, None] != ids[at][None])
                    total[d] += link.sum(axis=1)
                    found[d] += (link & (qc[:, None] == comps[at][None])).sum(axis=1)
        for d, (q, _, _) in tables.items():
            at = np.flatnonzero(total[d])
            yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(total[d][at]), pa.array(found[d][at])], ["id", "total", "found"])

    sums = placed.select("id", "dim", "vec", "component").mapInArrow(run, "id long, total long, found long").groupBy("id").agg(F.sum("total"), F.sum("found")).collect()  # at most `size`
    return np.array([r[2] / r[1] for r in sums])


def exact_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) that span every component: all vectors of a length meet in pairs of blocks."""
    sizes = reps.groupBy("dim").agg(F.count("*").alias("size"))
    rows = reps.join(F.broadcast(sizes), "dim").select(F.col("dim").alias("key"), "id", "vec", "size")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in groups(part, ["key", "lo", "hi"]):
            own, ids, v = g["own"].to_numpy(), g["id"].to_numpy(), matrix(g["vec"].tolist())
            a, b = np.flatnonzero(own == g["lo"].iloc[0]), np.flatnonzero(own == g["hi"].iloc[0])
            edges = np.empty((0, 2), np.int64)
            for at in range(0, len(a), STEP):
                i, j = np.nonzero(v[a[at : at + STEP]] @ v[b].T >= threshold)
                pairs = np.stack((ids[a[at + i]], ids[b[j]]), axis=1)
                pairs = np.concatenate((edges, pairs[pairs[:, 0] != pairs[:, 1]]))
                edges = pairs[spanning(pairs)]
            out.append(edges)
        edges = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    return binned(block_pairs(rows, "key", "id", "size", EXACT_BLOCK), run, "u long, v long")


def count_links(threshold: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids_out, n_out = [], []
        for g in groups(part, ["key", "lo", "hi"]):
            own, ids, weight = g["own"].to_numpy(), g["id"].to_numpy(), g["weight"].to_numpy()
            v = matrix(g["vec"].tolist())
            lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
            a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not len(a) or not len(b):
                continue
            link = (v[a] @ v[b].T >= threshold) & (ids[a][:, None] != ids[b][None])
            ids_out.append(ids[a])
            n_out.append(link @ weight[b])
            if lo != hi:
                ids_out.append(ids[b])
                n_out.append(link.T @ weight[a])
        return pd.DataFrame({"id": np.concatenate(ids_out) if ids_out else np.array([], np.int64), "n": np.concatenate(n_out) if n_out else np.array([], np.int64)})

    return run


def embedding_near_duplicates(df: DataFrame, threshold: float = 0.9, k: int = NEIGHBOURS, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """vec_id, embedding -> vec_id, n_links, component_id, kept, and the audited recall."""
    units = materialize(unit_vectors(df))
    for salt in itertools.count():
        reps = materialize(units.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("name"), F.count("*").alias("weight"), F.first("dim").alias("dim")).withColumn("id", F.xxhash64(F.lit(salt), "vec")))
        if reps.select("id").distinct().count() == reps.count():
            break

    def place(edges: DataFrame) -> DataFrame:
        components = connected_components(edges).withColumnRenamed("id", "_id")
        return materialize(reps.join(components, reps["id"] == components["_id"], "left").select("id", "dim", "vec", "weight", "name", F.coalesce("component", "id").alias("component"), F.col("_id").isNotNull().alias("linked")))

    state = first_graph(reps, k, threshold)
    for _ in range(rounds):
        state = descend(state, k)
        placed = place(state.select(F.col("id").alias("u"), F.explode(F.arrays_zip("ids", "sims")).alias("x")).where(F.col("x.sims") >= threshold).select("u", F.col("x.ids").alias("v")))
        share, least = audit(placed, threshold, recall)
        if least >= recall:
            break
        k *= 2
    else:
        placed, share = place(exact_edges(reps, threshold)), 1.0
    rows = placed.where("linked").withColumnRenamed("component", "key")
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("size")), "key").select("key", "id", "vec", "weight", "size")
    counted = binned(block_pairs(rows, "key", "id", "size", BLOCK), count_links(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    first = placed.groupBy("component").agg(F.min("name").alias("_c"), F.count("*").alias("n"))
    by_vec = spread_join(placed.drop("name"), first, ["component"]).join(counted, "id", "left").select(F.col("vec").alias("_v"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("_n"), "_c")
    out = units.join(by_vec, F.col("vec") == F.col("_v"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("_c", "vec_id"))
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(float(share)).alias("audited_recall"))
