"""Invariants of responses, chunk envelopes and tiers of the claim in force, case by case."""

import json
import random

from palimpsest.operators import responses


def test_each_invariant_breaks_alone(spark):
    authority = [("a", "c", "k", "CURRENT"), ("b", "c", "k2", "CURRENT"), ("x", "c", "k3", "CONFLICTING"), ("y", "c", "k3", "CONFLICTING"), ("o", "c", "k", "SUPERSEDED"), ("u", "c", "k4", "CURRENT")]
    cases = {  # name -> returned, full, characters, truncated, what is broken
        "right": ("a:CURRENT x:CONFLICTING y:CONFLICTING", "a x y", 50, False, ()), "none": ("", "", 99, False, ()), "edge": ("a:CURRENT", "a", 100, True, ()),
        "unquoted": ("u:CURRENT", "u", 50, False, ("provenance",)), "long": ("a:CURRENT", "a", 101, True, ("within_budget",)), "half": ("x:CONFLICTING", "x", 50, False, ("conflict_closed",)),
        "promoted": ("o:CURRENT", "o", 50, False, ("current_authority_preserved", "status_preserved")), "unsaid": ("a:CURRENT", "a b", 50, False, ("truncated_correct",)), "oversaid": ("a:CURRENT", "a", 50, True, ("truncated_correct",)),
        "swapped": ("a:CURRENT", "b", 50, False, ("truncated_correct",)), "foreign": ("z:SUPERSEDED", "z", 50, False, ("provenance", "temporal_scope_preserved", "status_preserved")), "wrong": ("a:CONFLICTING", "a", 50, False, ("status_preserved",)),
    }
    told = spark.createDataFrame([(q, n, 100, t) for q, (_, _, n, t, _) in cases.items()], "request_id string, characters int, budget int, truncated boolean")
    returned = spark.createDataFrame([(q, *x.split(":")) for q, c in cases.items() for x in c[0].split()], "request_id string, claim_id string, status string")
    full = spark.createDataFrame([(q, x) for q, c in cases.items() for x in c[1].split()], "request_id string, claim_id string")
    evidence = spark.createDataFrame([(x, True) for x in "abxyo"] + [("u", True), ("u", False)], "claim_id string, exact boolean")
    got = responses.invariants(told, returned.union(returned), full, spark.createDataFrame(authority, "claim_id string, corpus_id string, key string, status string"), evidence).collect()
    broken = {r.request_id: {n for n in responses.INVARIANTS if not r[n]} for r in got}
    assert broken == {q: set(c[4]) for q, c in cases.items()}


def envelope(question, chunks, truncated):
    return json.dumps({"chunks": chunks, "query": question, "truncated": truncated}, separators=(",", ":"), ensure_ascii=False)


def test_envelopes_are_those_of_real_json(spark):
    rng = random.Random(2)
    asks = [(q, "what \"is\"\n" + "é" * rng.randint(0, 60)) for q in range(12)] + [(20, "q" * 500), (21, "none")]
    cands = [(q, i, rng.choice((0.5, rng.random())), f"p/{i}", "".join(rng.choices('ab"\\\n é', k=rng.randint(0, 150)))) for q, _ in asks[:13] for i in range(rng.choice((1, 2, 30)))]
    want_rows, want = [], {}
    for q, question in asks:
        chunks, dropped = [], False
        mine = sorted((c for c in cands if c[0] == q), key=lambda c: (-c[2], c[1]))
        if len(envelope(question, [], True)) > 300:
            want[q] = (0, None, None, "envelope_exceeds_budget")
            continue
        for c in mine:
            trial = [*chunks, {"path": c[3], "text": c[4]}]
            if len(envelope(question, trial, True)) <= 300:
                chunks = trial
                want_rows.append((q, c[1], len(chunks)))
            else:
                dropped = True
        cut = dropped or len(envelope(question, chunks, False)) > 300
        want[q] = (len(chunks), len(envelope(question, chunks, cut)), cut, None)
    chosen, report = responses.chunk_envelopes(spark.createDataFrame(asks, "request_id long, question string"), spark.createDataFrame(cands, "request_id long, id long, score double, path string, text string"), 300)
    assert sorted(map(tuple, chosen.collect())) == sorted(want_rows) and {r[0]: tuple(r[1:]) for r in report.collect()} == want
    assert any(w[2] is False for w in want.values()) and any(w[2] for w in want.values())


def test_tiers_of_the_claim_in_force(spark):
    rows = [
        ("window", "a", "SUPERSEDED", "2024-01-01", "2024-01-01", "2024-03-01"), ("window", "b", "CURRENT", "2024-02-01", "2024-02-01", None), ("window", "c", "CURRENT", "2024-01-01", "2024-04-01", None),
        ("seen", "a", "SUPERSEDED", "2024-01-01", "2024-01-01", "2024-01-02"), ("seen", "b", "SUPERSEDED", "2024-01-05", "2024-01-01", "2024-01-02"), ("seen", "c", "CURRENT", "2024-03-01", "2024-03-01", None),
        ("later", "a", "UNCERTAIN", "2024-03-01", "2024-03-01", None), ("later", "b", "CURRENT", "2024-04-01", "2024-03-01", None), ("first", "b", "UNCERTAIN", "2024-03-01", "2024-03-01", None), ("first", "a", "UNCERTAIN", "2024-04-01", "2024-03-01", None),
    ]
    c = spark.createDataFrame([("c", *r) for r in rows], "corpus_id string, key string, claim_id string, status string, o string, f string, u string").selectExpr("corpus_id", "key", "claim_id", "status", "cast(o as timestamp) observed_at", "cast(f as timestamp) valid_from", "cast(u as timestamp) valid_until")
    assert {r.key: (r.claim_id, r.tier) for r in responses.in_force_tiers(c, "2024-02-10", "2024-02-10").collect()} == {"window": ("b", 1), "seen": ("b", 2), "later": ("b", 3), "first": ("b", 3)}
