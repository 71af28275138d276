"""Small cases of relevance, graph walks, Markdown, budgets, intervals and streams, incl. nulls, ties and empty tables."""

import math
import tempfile

import pytest

from palimpsest.operators import evaluate, graph, markdown, relevance, retrieve, state
from palimpsest.streaming import activity, lifecycle


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_overlap_and_adjudication(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Alpha BETA"), (2, "gamma"), (3, "absent"), (4, None)], "question_id long, text string")
    s = relevance.overlap_scores(q, docs)
    assert rows(s) == [(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]
    assert [r[:3] for r in rows(relevance.adjudicate(q, s, 0.3, 0.05))] == [(1, "ambiguous", 1), (2, "confident", 3), (3, "abstained", None), (4, "abstained", None)]
    assert rows(relevance.overlap_scores(q, docs.limit(0))) == []


def test_stem_cuts_the_first_suffix_that_leaves_more_than_three_letters(spark):
    df = spark.createDataFrame([("relations walking used sing cats was",)], "text string").select(relevance.terms(relevance.F.col("text")))
    assert df.first()[0] == ["relation", "walk", "used", "sing", "cats", "was"]


def test_trigrams_match_the_definition(spark):
    q, i = spark.createDataFrame([(1, "cat")], "query_id long, text string"), spark.createDataFrame([(2, "cat"), (3, "cap"), (4, None), (5, "dog")], "item_id long, text string")
    assert rows(relevance.trigram_scores(q, i)) == [(1, 2, 1.0), (1, 3, round(2 / 6, 6))]


def test_skip_budget_equals_a_loop(spark):
    data = [(r, i, (i * 7) % 11, 5 + (i * 13) % 17) for r in ("a", "b") for i in range(40)]
    got = rows(relevance.skip_budget(spark.createDataFrame(data, "request string, id long, score long, size long"), "request", 60, 30).select("request", "id"))
    want = []
    for r in ("a", "b"):
        left = 60
        for x in sorted((x for x in data if x[0] == r), key=lambda x: (-x[2], x[1]))[:30]:
            if x[3] <= left:
                left -= x[3]
                want.append((r, x[1]))
    assert got == sorted(want, key=repr)


def test_levels_and_heads(spark):
    chain = [(f"c{i:02}", f"c{i - 1:02}" if i else None) for i in range(20)] + [("fork", "c05"), ("lost", "unknown")]
    c = spark.createDataFrame(chain, "claim_id string, supersedes_id string")
    level = dict(rows(graph.levels(c)))
    assert level["c19"] == 19 and level["c00"] == 0 and level["fork"] == 6 and level["lost"] == 0
    heads = rows(graph.heads(c))
    assert ("c05", "c19") in heads and ("c05", "fork") in heads and ("c06", "fork") not in heads


def test_markdown_lines(spark):
    text = ["# A", "## B", "```", "# not", "```", "### C", "- x", "- x", "## D", "- x", "| k | v |", "|---|---|", "| 1 | |", "You must stop. Fine."]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id long, line_no long, line string")
    p = markdown.heading_paths(markdown.kinds(lines))
    kinds = {r["line_no"]: (r["kind"], r["path"]) for r in p.collect()}
    assert kinds[3] == ("block", "A > B") and kinds[6] == ("bullet", "A > B > C") and kinds[9] == ("bullet", "A > D")
    assert rows(markdown.statements(p)) == [(1, "A > B > C", "x", 6), (1, "A > D", "x", 9)]
    assert rows(markdown.table_rows(p)) == [(1, 12, "k: 1; v: ")]
    assert rows(markdown.normative(p, p.limit(0), "must")) == [(1, 13, 0, "You must stop.")]
    assert rows(markdown.normative(p, p, "must")) == []


@pytest.mark.parametrize("n", [1, 5000])
def test_bootstrap_is_near_the_normal_interval(spark, n):
    data = [("g", i, float((i * 7919) % 1000)) for i in range(n)] + [("g", -1, None)]
    r = evaluate.bootstrap(spark.createDataFrame(data, "g string, k long, x double"), "g", "k", "x").first()
    xs = [x for _, _, x in data if x is not None]
    mean = sum(xs) / n
    assert r["n"] == n and abs(r["mean"] - mean) < 1e-6
    half = 1.96 * math.sqrt(sum((x - mean) ** 2 for x in xs) / n / n)
    assert abs((r["high"] - r["low"]) / 2 - half) <= 0.15 * half and r["low"] <= mean <= r["high"]


def test_gate_fails_only_below_zero(spark):
    before = spark.createDataFrame([(g, i, float(i % 10)) for g in ("bad", "same") for i in range(300)], "g string, k long, x double")
    after = spark.createDataFrame([(g, i, float(i % 10) - (g == "bad") * (1 + i % 3)) for g in ("bad", "same") for i in range(300)], "g string, k long, x double")
    assert [(r["g"], r["verdict"]) for r in evaluate.regression_gate(before, after, "g", "k", "x").orderBy("g").collect()] == [("bad", "FAIL"), ("same", "PASS")]


def test_lifecycle_state_outlives_a_micro_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "user_id long, version_id long, observed_at timestamp, fp string"
    days = [["DELETED", "a"], ["a", "b", "DELETED"], ["DELETED", "b"]]
    n, out = 0, None
    for day, fps in enumerate(days):
        data = []
        for fp in fps:
            n += 1
            data.append((1, n, n, fp))
        df = spark.createDataFrame(data, "user_id long, version_id long, at long, fp string").selectExpr("user_id", "version_id", "timestamp_seconds(at) observed_at", "fp")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = activity.drain(lifecycle.lifecycle(spark.readStream.schema(schema).parquet(f"{folder}/in")), folder)
    assert rows(out.select("version_number", "version_id", "predecessor_id", "event")) == [(1, 2, None, "NEW"), (2, 4, 2, "MODIFIED"), (3, 5, 4, "DELETED"), (4, 7, 5, "RESTORED")]


def test_skip_budget_leaves_no_candidate_out(spark):
    data = [("a", i, (i * 7919) % 5003, 1 + (i * 31) % 90) for i in range(5000)]
    got = relevance.skip_budget(spark.createDataFrame(data, "request string, id long, score long, size long"), "request", 300).orderBy("rank").collect()
    left, want = 300, []
    for x in sorted(data, key=lambda x: (-x[2], x[1])):
        if x[3] <= left:
            left -= x[3]
            want.append(x[1])
    assert [r.id for r in got] == want and left == 0


def test_cycles_and_dangling_edges(spark):
    chain = [("a", None), ("b", "zz"), ("c", "b"), ("x", "y"), ("y", "x"), ("t", "x"), ("u", "t")] + [(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(700)]
    c = spark.createDataFrame(chain, "claim_id string, supersedes_id string")
    chains = dict(rows(state.lineage(c)))
    assert len(chains) == len(chain) and (chains["a"], chains["b"], chains["c"], chains["n0699"]) == ("a", "b", "b", "n0000")
    assert all(chains[i] is None for i in "xytu")
    level = dict(rows(graph.levels(c)))
    assert level["n0699"] == 699 and level["c"] == 1 and all(level[i] is None for i in "xytu")
    heads = rows(graph.heads(c))
    assert ("n0000", "n0699") in heads and ("x", "u") in heads and ("y", "u") in heads and ("t", "u") in heads
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "claim_id string, supersedes_id string")
    assert rows(graph.heads(loop)) == [("x", None), ("y", None)]


def test_conflict_sides(spark):
    r = spark.createDataFrame([("c", "k", i, f"id{i:02}", "CONFLICTING") for i in (1, 2, 2, 3)] + [("c", "k", 9, "gone", "SUPERSEDED")], "corpus_id string, key string, val int, claim_id string, status string")
    assert {(s, n) for _, s, n in rows(state.conflict_sides(r))} == {("id01", 3), ("id02", 3), ("id03", 3)}


def test_percentile_by_ranges(spark):
    data = [("a", i, float((i * i) % 9973)) for i in range(5000)] + [("b", i, 7.0) for i in range(50)] + [("c", 1, 3.0), ("c", 2, None)]
    got = {r.operation: (r.n, r.p95) for r in retrieve.latency_percentile(spark.createDataFrame(data, "operation string, query_id long, latency_ms double")).collect()}
    for op in "abc":
        x = sorted(v for o, _, v in data if o == op and v is not None)
        assert got[op] == (len(x), x[int(0.95 * (len(x) - 1))])
