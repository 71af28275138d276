"""Bounded packs: units taken greedily in field order while the whole canonical JSON of the answer fits its budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("current", "historical", "conflicts", "uncertain")  # the order of selection
PARTS = 64
_OF = {"CURRENT": 0, "SUPERSEDED": 1, "CONFLICTING": 2, "UNCERTAIN": 3}


def _envelope(request: Column) -> Column:
    """Characters of the answer without units; its truncated flag is reserved as true."""
    empty = '{"conflicts":[],"current":[],"historical":[],"request":,"truncated":true,"uncertain":[]}'
    return F.length(F.to_json(F.struct(request.alias("r")))) - len('{"r":}') + len(empty)


def units(resolved: DataFrame) -> DataFrame:
    """Claims with status -> request_id, field, unit_id, position, size: a claim, or all sides of a conflict at once.

    A conflict's size is summed up, so its sides never come together before it is known to fit.
    """
    body = F.length(F.to_json(F.struct("claim", "claim_id", "val")))
    field = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for s, i in _OF.items()])
    c = resolved.select(F.col("corpus_id").alias("request_id"), "key", "claim_id", field.alias("field"), body.alias("size"))
    single = c.where("field <> 2").select("request_id", "field", F.col("claim_id").alias("unit_id"), "size")
    key = F.length(F.to_json(F.struct("key"))) + len(',"claims":[]') - 1
    groups = c.where("field = 2").groupBy("request_id", "field", "key").agg((F.sum("size") + F.count("*") + F.max(key)).alias("size"))
    return single.unionByName(groups.select("request_id", "field", F.col("key").alias("unit_id"), "size"))


def bounded_pack(units: DataFrame, budget: int) -> DataFrame:
    """request_id, field, unit_id, size -> the units taken, with the characters of their answer and whether any was left out.

    Greedy in the order of field and unit_id; a unit that does not fit is passed over, later ones are still tried. Units of a
    field and size that are taken are the first of them in order, and no more than budget / size, so a request's candidates
    are bounded whatever their number, and those beyond can never be taken. A request whose empty answer exceeds the budget
    has no row. The flag counts: an answer that has everything says false, a character longer, if that still fits.
    """
    # first inside parts of a class, so that a hot request's most common size is not one task's; what a part drops, the class does too
    first = lambda *by: F.row_number().over(Window.partitionBy("request_id", "field", "size", *by).orderBy("unit_id")) * F.col("size") <= budget
    total = units.groupBy("request_id").agg(F.count("*").alias("n_units"))
    near = units.where(F.col("size") <= budget).withColumn("_part", F.pmod(F.xxhash64("unit_id"), F.lit(PARTS))).withColumn("_in", first("_part")).where("_in")
    near = near.withColumn("_in", first()).where("_in")
    listed = near.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("field", "unit_id", "size"))).alias("u"))
    start = F.struct(_envelope(F.col("request_id")).cast("long").alias("used"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FIELDS))]), x["field"] + 1)
        later = s["seen"].bitwiseAND(bit) != 0  # a comma stands before all but the first of a field
        cost = s["used"] + x["size"] + later.cast("int")
        fits = cost <= budget
        return F.struct(F.when(fits, cost).otherwise(s["used"]).cast("long").alias("used"), F.when(fits, s["seen"].bitwiseOR(bit)).otherwise(s["seen"]).alias("seen"), F.when(fits, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

    packed = listed.join(total, "request_id").withColumn("s", F.aggregate("u", start, step)).where(_envelope(F.col("request_id")) <= budget)
    whole = (F.size("s.at") == F.col("n_units")) & (F.col("s.used") + 1 <= budget)
    out = packed.select("request_id", F.when(whole, F.col("s.used") + 1).otherwise(F.col("s.used")).alias("n_chars"), (~whole).alias("truncated"), F.explode(F.transform("s.at", lambda i: F.get("u", i))).alias("x"))
    names = F.array(*map(F.lit, FIELDS))
    return out.select("request_id", F.get(names, F.col("x.field")).alias("field"), "x.unit_id", "x.size", "n_chars", "truncated")
