"""Stated queries against all items, scored block by block: the best of each query, or the places of asked pairs.

Queries and items are dealt into cells of bounded size; a cell scores its queries with its items as matrices, and only what the
result needs leaves it. So pairs are computed (their number is queries times items by nature), but never stored or shuffled.
Scores equal those of Spark's expressions to the last bit, rounding included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEMS, QUERIES, ROWS = 32_768, 4_096, 128  # items and queries of a cell, queries scored at once
WIDE = 8 * ROWS  # queries whose common grams are counted at once
LEAST = 512  # items of a cell, at least, where there are more cores than cells

Scorer = Callable[[pd.Series, pd.Series], Callable[[int, int], np.ndarray]]  # features -> scores of queries [a, b) with all items; NaN: not a number


def rounded(x: np.ndarray, error: np.ndarray | float, exact: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """round(x, 6) as Spark has it: half up over the shortest decimal. `exact` gives the values at flat places near a half."""
    y = x * 1e6
    out = np.floor(y + 0.5)
    y -= out
    np.abs(y, out=y)
    near = np.flatnonzero((np.abs(y - 0.5) <= 1e-4 + 1e6 * error) | (np.abs(out) > 1e14))  # NaN and infinity stay
    out /= 1e6
    if len(near):
        flat = out.reshape(-1)
        values, at = np.unique(exact(near), return_inverse=True)
        flat[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in values])[at]
    return out


def dots(q: pd.Series, v: pd.Series) -> Callable[[int, int], np.ndarray]:
    """Dot products of vectors of one length, summed from the first component on."""
    a, b = (np.stack(x.to_numpy()).astype("float64") for x in (q, v))
    size = np.sqrt((b * b).sum(axis=1)) * (b.shape[1] + 1) * 4e-16

    def score(start: int, end: int) -> np.ndarray:
        with np.errstate(all="ignore"):
            part = a[start:end]
            near = part @ b.T

            def exact(flat: np.ndarray) -> np.ndarray:
                values = [np.add.accumulate(part[f // len(b)] * b[f % len(b)], axis=1)[:, -1] for f in np.array_split(flat, len(flat) // 50_000 + 1)]
                near.reshape(-1)[flat] = np.concatenate(values)
                return near.reshape(-1)[flat]

            return rounded(near, np.sqrt((part * part).sum(axis=1))[:, None] * size, exact)

    return score


def common_share(q: pd.Series, v: pd.Series) -> Callable[[int, int], np.ndarray]:
    """Size of the intersection over that of the union, of sets of small numbers; 0 where nothing is in common."""
    nq, ni = q.str.len().to_numpy(), v.str.len().to_numpy()
    flat, ends = np.concatenate([*v.to_numpy(), np.empty(0, "int64")]).astype("int64"), np.cumsum(ni)

    def counts(start: int, end: int) -> np.ndarray:
        grams, row = np.unique(np.concatenate([*q.to_numpy()[start:end], np.empty(0, "int64")]).astype("int64"), return_inverse=True)
        has = np.zeros((len(grams) + 1, end - start), "uint8" if nq[start:end].max(initial=0) < 256 else "int32")  # the last row is of other grams
        has[row, np.repeat(np.arange(end - start), nq[start:end])] = 1
        place = np.searchsorted(grams, flat)
        place[np.r_[grams, -1][place] != flat] = len(grams)
        both = np.empty((len(ni), end - start), has.dtype)
        for i, (e, n) in enumerate(zip(ends, ni)):
            np.add.reduce(has[place[e - n : e]], axis=0, dtype=has.dtype, out=both[i])
        return both

    held: dict[int, np.ndarray] = {}

    def score(start: int, end: int) -> np.ndarray:
        wide = start // WIDE * WIDE
        if wide not in held:
            held.clear()
            held[wide] = counts(wide, min(wide + WIDE, len(q)))
        both = np.ascontiguousarray(held[wide][:, start - wide : end - wide].T)
        share = both / np.maximum(nq[start:end, None] + ni - both.astype("int32"), 1)
        return rounded(share, 0.0, lambda at: share.reshape(-1)[at])

    return score


def cells(queries: DataFrame, items: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(queries, items) of every cell: each query meets each item in one of them. Null ids meet nothing."""
    queries, items = queries.where("query_id is not null"), items.where("item_id is not null")
    n, m = items.count(), queries.count()
    cores = items.sparkSession.sparkContext.defaultParallelism
    ni, nq = max(1, -(-n // ITEMS), min(cores, -(-n // LEAST))), max(1, -(-m // QUERIES))
    deal = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = queries.select("*", deal("query_id", nq).alias("_q"), every(ni).alias("_i"))
    i = items.select("*", deal("item_id", ni).alias("_i"), every(nq).alias("_q"))
    return q.groupBy("_q", "_i").cogroup(i.groupBy("_q", "_i")).applyInPandas(work, schema)


def chosen(q: np.ndarray, i: np.ndarray, s: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each row: NaN first, higher scores first, then smaller ids."""
    nan = np.isnan(s)
    order = np.lexsort((i, np.where(nan, 0.0, -s), ~nan, row))
    starts = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0]) if len(order) else np.empty(0, "int64")
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[nth < k]


def scored(q: pd.DataFrame, items: pd.DataFrame, scorer: Scorer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of some queries, their scores with all items)."""
    score = scorer(q["feature"], items["feature"])
    for a in range(0, len(q), ROWS):
        yield q["query_id"].to_numpy()[a : a + ROWS], score(a, min(a + ROWS, len(q)))


def nearest(queries: DataFrame, items: DataFrame, k: int, scorer: Scorer, positive: bool = False) -> DataFrame:
    """(query_id, feature) x (item_id, feature) -> query_id, item_id, score, rank: the k best other items, ties by item_id.

    Features that are null or of another length than the query's (vectors) score null, which comes last; with `positive`
    (sets) nothing but scores above 0 counts.
    """
    kind = {f.name: f.dataType.simpleString() for f in (*queries.schema, *items.schema)}

    def work(q: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": q["query_id"][:0], "item_id": items["item_id"][:0], "score": np.empty(0), "nan": np.empty(0, bool)})]
        size = lambda df: pd.Series([-1 if x is None else 0 if positive else len(x) for x in df["feature"]], index=df.index, dtype="int64")
        lengths, own = size(q), size(items)
        for n in lengths.unique():
            asked = q[lengths == n]
            met, odd = (items[own == n], items[own != n]) if n >= 0 else (items[:0], items)
            ids = met["item_id"].to_numpy()
            for names, s in scored(asked, met, scorer) if len(met) else ():
                s[names[:, None] == ids] = -np.inf
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
                row, at = np.nonzero(~(s < least) & (s > 0) if positive else ~(s < least))
                other = names[row] != ids[at]
                row, at = row[other], at[other]
                c = chosen(names[row], ids[at], s[row, at], row, k)
                found.append(pd.DataFrame({"query_id": names[row[c]], "item_id": ids[at[c]], "score": s[row[c], at[c]], "nan": np.isnan(s[row[c], at[c]])}))
            if len(odd) and not positive:
                first = odd[["item_id"]].sort_values("item_id").head(k + 1)
                found.append(asked[["query_id"]].merge(first, how="cross").query("query_id != item_id").assign(score=np.nan, nan=False))
        return pd.concat([f for f in found if len(f)] or found)

    best = cells(queries, items, work, f"query_id {kind['query_id']}, item_id {kind['item_id']}, score double, nan boolean")
    best = best.select("query_id", "item_id", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))  # pandas has one value for NaN and null
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def gram_numbers(grams: Column) -> Column:
    """Numbers of 3-grams over ASCII characters."""
    return F.transform(grams, lambda g: F.ascii(g) * 16384 + F.ascii(g.substr(2, 1)) * 128 + F.ascii(g.substr(3, 1)))


def matrices(q: pd.DataFrame, items: pd.DataFrame, scorer: Scorer, sets: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(some queries of one length, their scores with all items, which of these are null)."""
    size = lambda df: pd.Series([-1 if x is None else 0 if sets else len(x) for x in df["feature"]], index=df.index, dtype="int64")
    lengths, own = size(q), size(items).to_numpy()
    for n in lengths.unique():
        asked, met = q[lengths == n], own == n if n >= 0 else own != own
        score = scorer(asked["feature"], items["feature"][met]) if met.any() else None
        for a in range(0, len(asked), ROWS):
            part = asked[a : a + ROWS]
            s = np.full((len(part), len(items)), np.nan)
            if score:
                s[:, met] = score(a, a + len(part))
            yield part, s, np.broadcast_to(~met, s.shape)


def _asked(queries: DataFrame, asked: DataFrame) -> DataFrame:
    """Each query with its asked pairs as arrays; `_kind` says what a score is, as pandas has one value for NaN and null."""
    kind = F.when(F.col("score").isNull(), 2).when(F.isnan("score"), 0).otherwise(1)
    rows = asked.groupBy("query_id").agg(F.collect_list(F.struct("item_id", F.coalesce("score", F.lit(0.0)).alias("s"), kind.alias("k"))).alias("_a"))
    return queries.join(rows.select("query_id", *[F.col(f"_a.{c}").alias(n) for c, n in (("item_id", "_ids"), ("s", "_s"), ("k", "_kind"))]), "query_id")


def scores_of(queries: DataFrame, items: DataFrame, asked: DataFrame, scorer: Scorer, sets: bool = False) -> DataFrame:
    """query_id, item_id, score of asked pairs (query_id, item_id), some hundreds for each query."""

    def work(q: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": q["query_id"][:0], "item_id": items["item_id"][:0], "score": np.empty(0), "nan": np.empty(0, bool)})]
        items = items.sort_values("item_id")
        ids = items["item_id"].to_numpy()
        for part, s, null in matrices(q, items, scorer, sets) if len(items) else ():
            for r, (name, want) in enumerate(zip(part["query_id"], part["_ids"])):
                at = np.flatnonzero(np.isin(ids, want))
                found.append(pd.DataFrame({"query_id": name, "item_id": ids[at], "score": s[r, at], "nan": np.isnan(s[r, at]) & ~null[r, at]}))
        return pd.concat([f for f in found if len(f)] or found)

    q = _asked(queries, asked.withColumn("score", F.lit(0.0)))
    out = cells(q, items, work, f"query_id {q.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double, nan boolean")
    return out.select("query_id", "item_id", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))


def ordered(s: np.ndarray, null: np.ndarray, a: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers for the scores of pairs and asked ones, smaller for what comes first: NaN, high scores, low ones, null."""
    if not null.any() and (kind == 1).all() and np.isfinite(s).all() and max(np.abs(s).max(initial=0), np.abs(a).max(initial=0)) < 1e7:
        return (-np.rint(s * 1e6)).astype("int64"), (-np.rint(a * 1e6)).astype("int64")
    values, at = np.unique(np.concatenate([s.reshape(-1), np.where(kind == 0, np.nan, a)]), return_inverse=True)
    key = len(values) - at.astype("int64")
    of, asked = key[: s.size].reshape(s.shape), key[s.size :]
    return np.where(null, len(values) + 1, of), np.where(kind == 2, len(values) + 1, asked)


def places(queries: DataFrame, items: DataFrame, asked: DataFrame, scorer: Scorer, sets: bool = False) -> DataFrame:
    """(query_id, item_id, score), asked -> query_id, item_id, n_better, held: a pair's place in its query's whole list.

    n_better: other items that come first, by score, then id. Of sets only scores above 0 make the list; a pair with score 0
    is told how many of the list have a smaller id. held: how many other items score above 0. No list is put in order as a
    whole: each cell counts for itself, and the counts are added.
    """

    def work(q: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": q["query_id"][:0], "item_id": items["item_id"][:0], "n_better": np.empty(0, "int64"), "held": np.empty(0, "int64")})]
        items = items.sort_values("item_id")
        ids = items["item_id"].to_numpy()
        bits, own = len(ids).bit_length(), np.arange(len(ids))
        for part, s, null in matrices(q, items, scorer, sets) if len(items) else ():
            ends = np.cumsum([0, *part["_ids"].str.len()])
            scores, kinds = np.concatenate(part["_s"].to_numpy()), np.concatenate(part["_kind"].to_numpy())
            of, want = ordered(s, null, scores, kinds)
            of = (of << bits) + own
            for r, (name, names) in enumerate(zip(part["query_id"], part["_ids"])):
                at = np.searchsorted(ids, names)
                key = (want[ends[r] : ends[r + 1]] << bits) + at
                self_ = np.flatnonzero(ids == name)
                better = np.searchsorted(np.sort(of[r]), key) - (of[r, self_][:, None] < key).sum(axis=0)
                above = s[r] > 0
                above[self_] = False
                if sets:
                    upto = np.r_[0, np.cumsum(above)]
                    better = np.where(scores[ends[r] : ends[r + 1]] > 0, better, upto[at])
                found.append(pd.DataFrame({"query_id": name, "item_id": names, "n_better": better, "held": above.sum()}))
        return pd.concat([f for f in found if len(f)] or found)

    q = _asked(queries, asked)
    out = cells(q, items, work, f"query_id {q.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_better long, held long")
    return out.groupBy("query_id", "item_id").agg(F.sum("n_better").alias("n_better"), F.sum("held").alias("held"))
