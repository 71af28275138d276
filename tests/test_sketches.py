"""Sketches differ from one evaluation to the next; results must not."""

import random
from statistics import median

from pyspark.sql import functions as F

from palimpsest.operators import retrieve
from palimpsest.operators.maintain import sample_stats


def test_medians_do_not_depend_on_the_sketch(spark, monkeypatch):
    """Each evaluation of the sketch gives other cuts, as it may where parts arrive in another order."""
    cuts = F.udf(lambda most: sorted(random.SystemRandom().uniform(0, most) for _ in range(20)), "array<double>").asNondeterministic()
    monkeypatch.setattr(retrieve.F, "percentile_approx", lambda value, *_: cuts(F.max(value)))
    rng = random.Random(4)
    groups = {g: [rng.random() * 100 for _ in range(n)] for g, n in (("a", 501), ("b", 400), ("c", 333))}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    for _ in range(3):
        assert {r.g: r.median for r in sample_stats(df, "g", "x").collect()} == {g: round(median(xs), 4) for g, xs in groups.items()}
