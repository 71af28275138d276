"""Live-index maintenance, audits across tables and evaluation metrics, as set jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.retrieve import medians
from palimpsest.operators.state import instant, latest_versions


def active_claims(v: DataFrame, c: DataFrame) -> DataFrame:
    """Claims of a document's latest live version that no claim supersedes."""
    live = latest_versions(v).where("event <> 'DELETED'").select("version_id")
    retired = c.where("supersedes_id is not null").select(F.col("supersedes_id").alias("claim_id"))
    return c.join(live, "version_id", "left_semi").join(retired, "claim_id", "left_anti")


def tombstones(v: DataFrame, targets: DataFrame) -> DataFrame:
    """The next version row of each targeted (doc_id) that is live: a DELETED one after its latest version."""
    latest = latest_versions(v).where("event <> 'DELETED'").join(targets, "doc_id", "left_semi")
    return latest.select("corpus_id", "doc_id", (F.col("version_number") + 1).alias("version_number"), F.col("version_id").alias("predecessor_id"), F.lit("DELETED").alias("event"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, id, hash) tables: new keys are added, changed hashes replace while the id stays, equal hashes do nothing."""
    j = existing.select(key, F.col("id").alias("old_id"), F.col("hash").alias("old")).join(incoming.select(key, F.col("id").alias("new_id"), F.col("hash").alias("new")), key, "full_outer")
    return j.select(key, F.coalesce("old_id", "new_id").alias("id"), F.coalesce("new", "old").alias("hash"), (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("written"))


def erasure_report(tables: dict[str, DataFrame], corpus: str) -> DataFrame:
    """Rows that erasing a corpus removes from each table, and rows that stay."""
    out = None
    for name, df in tables.items():
        gone = F.col("corpus_id") == corpus
        one = df.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("left")).select(F.lit(name).alias("table_name"), "removed", "left")
        out = one if out is None else out.unionByName(one)
    return out


def audit_unique(c: DataFrame) -> DataFrame:
    """(version, key) pairs that hold several claims."""
    return c.groupBy("version_id", "key").agg(F.count("*").alias("n")).where("n > 1")


def validity_by_day(c: DataFrame, days: DataFrame) -> DataFrame:
    """Claims in force on each day: windows are bounded by the days asked, then become +1 and -1 steps summed up.

    So an open window costs two rows however long it lasts; the running sum is over as many rows as there are days.
    """
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    w = c.join(F.broadcast(span)).select("lo", "hi", F.to_date("valid_from").alias("s"), F.to_date("valid_until").alias("e"))
    up = w.where("s <= hi").select(F.greatest("s", "lo").alias("day"), F.lit(1).alias("step"))
    down = w.where("e <= hi").select(F.greatest("e", "lo").alias("day"), F.lit(-1).alias("step"))
    steps = up.union(down).groupBy("day").agg(F.sum("step").alias("step"))
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(steps, "day", "left").select("day", F.sum(F.coalesce("step", F.lit(0))).over(order).alias("n_valid"))


def resolve_prefixes(c: DataFrame, refs: DataFrame, length: int) -> DataFrame:
    """(ref) prefixes of `length` characters -> number of claims they may mean, and resolved, ambiguous or missing.

    An equi-join on the cut id, so nothing is compared with everything.
    """
    heads = c.groupBy(F.substring("claim_id", 1, length).alias("ref")).agg(F.count("*").alias("n"), F.min("claim_id").alias("only"))
    j = refs.join(heads, "ref", "left")
    return j.select("ref", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("only")).alias("claim_id"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("outcome"))


def confusion(rows: DataFrame, by: str) -> DataFrame:
    """(by, actual, predicted) booleans -> precision, recall, specificity and F1; null where a denominator is zero."""
    a, p = F.col("actual"), F.col("predicted")
    m = rows.groupBy(by).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    ratio = lambda x, y: F.round(F.try_divide(x, y), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return m.select(by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def sample_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median and sample deviation (0 below two samples); the median by ranges, so that no group's values are in one place."""
    per = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("stdev"))
    middle = medians(rows, by, value).select(F.col(by).alias("_by"), F.round("median", 4).alias("median"))
    return per.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "median", "stdev")


def review_sample(rows: DataFrame, stratum: str, order: str, most: int) -> DataFrame:
    """At most `most` rows a stratum, in a deterministic order."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("position") <= most)


def stride_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, text -> chunks of `size` characters, each `overlap` into the one before; the last ends with the text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step)).cast("int")
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("order_index"))
    return rows.select("doc_id", "order_index", F.substring("text", F.col("order_index") * step + 1, F.lit(size)).alias("chunk"))


def statements(turns: DataFrame) -> DataFrame:
    """User turns as statements: white space collapsed, marks stripped; each supersedes the one before in its conversation."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "^[# ]+", ""))
    order = Window.partitionBy("conv_id").orderBy("turn")
    s = turns.where("role = 'user'").select("conv_id", "turn", text.alias("statement")).where("statement <> ''")
    return s.withColumns({"replaces": F.lag("turn").over(order), "digest": F.sha2("statement", 256), "tokens": F.greatest(F.lit(1), F.floor(F.length("statement") / 4))})
