"""Scores of runs against labels: set scores, outcome rollups, bootstrap intervals and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def set_scores(expected: DataFrame, actual: DataFrame, by: str) -> DataFrame:
    """(by, item) sets -> hits, missing, unexpected, recall and whether they are equal; by join, never as gathered sets."""
    e, a = expected.select(by, "item").distinct().withColumn("_e", F.lit(True)), actual.select(by, "item").distinct().withColumn("_a", F.lit(True))
    j = e.join(a, [by, "item"], "full_outer")
    hit, missing, extra = F.count_if(F.col("_e") & F.col("_a")), F.count_if(F.col("_a").isNull()), F.count_if(F.col("_e").isNull())
    return j.groupBy(by).agg(hit.alias("hits"), missing.alias("missing"), extra.alias("unexpected"), F.round(F.try_divide(hit, hit + missing), 6).alias("recall"), ((missing + extra) == 0).alias("exact"))


def outcomes(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(actual, answered, right) -> shares by group, subgroup and overall; null names stand for all."""
    right = F.col("right") & F.col("answered")
    return rows.rollup(first, second).agg(F.count("*").alias("n"), F.round(F.avg(right.cast("int")), 6).alias("correct"), F.round(F.avg((~F.col("right") & F.col("answered")).cast("int")), 6).alias("confident_wrong"), F.round(F.avg((~F.col("answered")).cast("int")), 6).alias("abstained"))


def bootstrap(samples: DataFrame, by: str, key: str, value: str, rounds: int = 2000, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean. Reruns agree.

    Samples are dealt to 256 buckets a group by a hash of their key and summed there, so each round draws Poisson(1)
    weights for buckets and not for samples: rounds x 256 rows a group, however many samples there are.
    """
    b = samples.where(F.col(value).isNotNull()).groupBy(by, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_b")).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count("*").alias("_n"))
    u = F.pmod(F.xxhash64("_b", "_r"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight, reach, p = F.lit(0), 0.0, 0.36787944117144233  # exp(-1)
    for k in range(8):
        reach += p
        weight, p = weight + (u >= reach).cast("int"), p / (k + 1)
    drawn = b.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_w", weight)
    mean = drawn.groupBy(by, "_r").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("_m")).where("_m is not null")
    order = F.row_number().over(Window.partitionBy(by).orderBy("_m")) - 1
    cut = int((1 - level) / 2 * rounds)
    lo, hi = F.min(F.when(F.col("_i") >= cut, F.col("_m"))), F.max(F.when(F.col("_i") <= rounds - 1 - cut, F.col("_m")))
    interval = mean.withColumn("_i", order).groupBy(by).agg(F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))
    return b.groupBy(by).agg(F.sum("_n").alias("n"), F.round(F.sum("_s") / F.sum("_n"), 6).alias("mean")).join(interval, by)


def regression_gate(before: DataFrame, after: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Paired differences, query by query: FAIL only where the whole interval lies below zero."""
    pairs = before.select(by, key, F.col(value).alias("_x")).join(after.select(by, key, F.col(value).alias("_y")), [by, key]).select(by, key, (F.col("_y") - F.col("_x")).alias("diff"))
    return bootstrap(pairs, by, key, "diff").withColumn("verdict", F.when(F.col("high") < 0, "FAIL").otherwise("PASS"))
