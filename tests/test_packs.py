"""Bounded packs against a plain greedy selection that writes the whole JSON for every try."""

import json
import random

import pytest

from palimpsest.operators import packs


def text(request, chosen, truncated):
    out = {f: [u for g, u in chosen if g == f] for f in packs.FIELDS}
    return json.dumps({**out, "request": request, "truncated": truncated}, sort_keys=True, separators=(",", ":"))


def greedy(request, units, budget):
    """units: (field, id, JSON object) in order."""
    chosen, dropped = [], False
    if len(text(request, [], True)) > budget:
        return None
    for field, _, body in units:
        if len(text(request, [*chosen, (field, body)], True)) <= budget:
            chosen.append((field, body))
        else:
            dropped = True
    truncated = dropped or len(text(request, chosen, False)) > budget
    return len(text(request, chosen, truncated)), truncated, {b["claim_id"] if "claim_id" in b else b["key"] for _, b in chosen}


@pytest.mark.parametrize("budget", [60, 88, 150, 400, 1200, 100_000])
def test_equals_plain_greedy(spark, budget):
    rnd = random.Random(budget)
    rows, want = [], {}
    for request in ("a", "quo\"te", "c"):
        claims = [(request, f"k{rnd.randrange(4)}", f"{i:03}", "x" * rnd.choice((1, 1, 5, 30, 200)), rnd.choice(("CURRENT", "SUPERSEDED", "CONFLICTING", "UNCERTAIN")), i) for i in range(30)]
        rows += claims
        body = lambda c: {"claim": c[3], "claim_id": c[2], "val": c[5]}
        single = {"CURRENT": "current", "SUPERSEDED": "historical", "UNCERTAIN": "uncertain"}
        units = [(single[c[4]], c[2], body(c)) for c in claims if c[4] in single]
        keys = sorted({c[1] for c in claims if c[4] == "CONFLICTING"})
        units += [("conflicts", k, {"key": k, "claims": [body(c) for c in claims if c[4] == "CONFLICTING" and c[1] == k]}) for k in keys]
        want[request] = greedy(request, sorted(units, key=lambda u: (packs.FIELDS.index(u[0]), u[1])), budget)
    df = spark.createDataFrame(rows, "corpus_id string, key string, claim_id string, claim string, status string, val int")
    got = {}
    for r in packs.bounded_pack(packs.units(df), budget).collect():
        got.setdefault(r.request_id, (r.n_chars, r.truncated, set()))[2].add(r.unit_id)
    assert got == {k: v for k, v in want.items() if v and v[2]}  # an answer without units has no row
