"""Filter audit, suffix-array dedup and prefix trie against brute force, with their edge cases."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from palimpsest.llm import audit, oracles, suffixes, trie

SF = "/root/testdata/sf0.001"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- filter audit ---------------------------------------------------------------------------------------------------

LONG = " ".join(f"w{i}" for i in range(210))
TEXTS = [LONG, LONG, LONG + " $", "Ab CD", "", None, "x " * 300, LONG.upper(), LONG + " é" * 9, "\x0b\x1c one two", "long " * 60000]
DOCS = [(i, t, s) for i, (t, s) in enumerate(zip(TEXTS * 3, itertools.cycle(["a", None, "", "b"])))] + [(None, LONG, "a"), (None, "", "c"), (7, TEXTS[7], "a"), (7, TEXTS[7], "a"), (40, "a b", "d"), (-3, "a b", "d")]
LABELS = [(0, 1, 0), (0, 0, 1), (1, 1, None), (2, None, 1), (3, 0, 0), (None, 1, 1), (7, 1, 1), (10**9, 1, 1)]


def failed(docs):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, source in docs:
        t = t or ""
        w = [x for x in t.translate({c: 32 for c in range(9, 14)}).split(" ") if x]
        f = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else "")
        f += ("D" if set(t) & set("#$%&*|") else "") + ("E" if i is not None and least[t] < i else "")
        yield source or "", f, i


def test_filter_audit_equals_each_order_applied(spark):
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    parts = collections.defaultdict(list)
    for part, f, i in failed(DOCS):
        parts[part].append((f, i))
    want, share = {}, collections.Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                share[part, x] += len(gone)
                every = [r for r in rows if x in r[0]]
                want[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), sum(r[0] == x for r in rows), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
    docs = table(spark, [(*d, 1, 2) for d in DOCS], "doc_id long, text string, source string, mask int, part int")
    labels = table(spark, LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.filter_audit(docs, labels).collect()}
    assert got == {k: [*v, share[k[0], k[1][k[2] - 1]]] for k, v in want.items()}


def test_filter_audit_equals_sql(spark, duck):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    assert sorted(map(tuple, audit.filter_audit(docs, labels).collect())) == sorted(duck.sql(oracles.FILTER_AUDIT).fetchall())


def test_removal_steps_are_least_positions():
    orders, at, step = audit.removal_steps(4)
    for m, (o, order) in itertools.product(range(16), enumerate(orders)):
        hit = [k for k, f in enumerate(order, 1) if m >> f & 1]
        assert step[m, o] == (hit[0] if hit else np.inf)
    one = audit.order_effects(pd.DataFrame({"mask": [3], "good": [True], "toxic": [False], "n": [5]}), "AB")
    assert one[["filter_order", "step", "removed", "redundant", "good_lost", "shapley"]].to_numpy().tolist() == [["AB", 1, 5, 0, 5, 5], ["AB", 2, 0, 5, 0, 5], ["BA", 1, 5, 0, 5, 5], ["BA", 2, 0, 5, 0, 5]]


def test_filter_audit_of_empty_tables(spark):
    labels = table(spark, [], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(table(spark, [], "doc_id long, text string, source string"), labels).count() == 0
    assert audit.filter_audit(table(spark, [(1, None, None)], "doc_id long, text string, source string"), labels).count() == 600


# --- suffix-array dedup ---------------------------------------------------------------------------------------------


def cut(rows, window, first=False):
    """Brute force over all windows; first: only copies of an earlier (doc_id, text, position) go."""
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.defaultdict(set)
    for r, t in enumerate(texts):
        for p in range(len(t) - window + 1):
            seen[t[p : p + window]].add((r, p))
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    place = {r: k for k, r in enumerate(order)}
    out = []
    for r, t in enumerate(texts):
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            at = seen[t[p : p + window]]
            if len(at) > 1 and (not first or min((place[x], y) for x, y in at) < (place[r], p)):
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((rows[r][0], len(t), len(t) - len(kept), sum(g and not before for before, g in zip(b"\0" + gone, gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pieces():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé \0") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    for _ in range(140):
        a, b = rng.choice(texts), rng.choice(texts)
        texts.append((a[rng.randrange(len(a) + 1) :] + b[: rng.randrange(len(b) + 1)])[:2000])
    return list(enumerate([*texts, "ab" * 700, "ab" * 700 + "x", "z" * 3000, None, ""]))


SCHEMA = "doc_id long, text string, key string, h int"


@pytest.mark.parametrize("light", [suffixes.LIGHT, 3])
def test_repeated_bytes_equal_all_windows(spark, pieces, light):
    rows = [*pieces, (5, pieces[5][1]), (3, pieces[3][1]), (None, pieces[7][1]), (None, "q" * 300), (None, "q" * 199 + "r"), (5, "r" * 250)]
    got = suffixes.repeated_bytes(table(spark, [(*r, "k", 1) for r in rows], SCHEMA), light=light).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == cut(rows, 200)
    assert all(r.n_removed == sum(x.hi - x.lo for x in r.runs or []) and r.n_spans == len(r.runs or []) for r in got)


@pytest.mark.parametrize("light", [suffixes.LIGHT, 3])
def test_first_copies_stay(spark, pieces, light):
    got = suffixes.repeated_bytes(table(spark, [(*r, "k", 1) for r in pieces], SCHEMA), keep="first", light=light).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == cut(pieces, 200, first=True)


def test_other_windows(spark, pieces):
    got = suffixes.repeated_bytes(table(spark, [(*r, "k", 1) for r in pieces], SCHEMA), window=50, node=16).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == cut(pieces, 50)


def test_window_length_is_exact(spark):
    rng = random.Random(8)
    a = "".join(rng.choice("0123456789abcdef") for _ in range(200))
    rows = [(1, a), (2, "u" + a + "v"), (3, a[:199] + "!"), (4, a[1:] + "?"), (5, "é" * 100 + "x"), (6, "é" * 100 + "y")]
    assert [(r.n_removed, r.n_spans) for r in sorted(suffixes.repeated_bytes(table(spark, rows, "doc_id long, text string")).collect())] == [(200, 1), (200, 1), (0, 0), (0, 0), (200, 1), (200, 1)]
    assert suffixes.repeated_bytes(table(spark, [], "doc_id long, text string")).count() == 0


def test_orders_and_neighbours():
    rng = np.random.default_rng(1)
    around = rng.integers(0, 3, (40, 30), np.uint8)
    for start, order in suffixes.suffix_order(around, 12):
        tails = [around[i, start:].tobytes() for i in order]
        assert tails == sorted(tails)
    for _ in range(50):
        run = np.cumsum(rng.random(12) < 0.4)
        place = rng.permutation(12)
        smaller, larger = suffixes.matched_neighbours(place, run)
        for i in range(12):
            same = [place[j] for j in range(12) if run[j] == run[i]]
            assert (smaller[i], larger[i]) == (min(same) < place[i], max(same) > place[i])


# --- prefix trie ----------------------------------------------------------------------------------------------------


def nodes_of(rows):
    """Every node of the rebuilt conversations, walked turn by turn."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        seq = (*own.get(c - c % 20, [])[:h], *own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, m in members.items():
        words = len(s[-1][1].encode().split()) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * words
            leaves[s[:d]] += not children[s]
    return sorted((m[0], len(s), members[s[:-1]][0] if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()) for s, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def test_trie_equals_walking(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 130), 10**12, 10**12 + 19]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 17])):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["a b", "a b c", "", None, "d\x1ce\x0bf"])))
    rows += [(7, None, "user", "first"), (9, 3, "user", "tie"), (9, 3, "user", "tie"), (9, 3, "bot", "tie"), (None, 1, "user", "nobody"), (300, 1, None, None), (301, 5, "x", "long " * 60000)]
    wide = table(spark, [(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, c int, d int, size int")
    assert trie_rows(trie.conversation_trie(wide)) == nodes_of(rows)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 33])
def test_trie_of_a_hot_conversation(spark, n):
    rows = [(c, t, "user", f"turn {t}" if c % 3 else f"turn {t} {c * (t >= n // 2)}") for c in range(60) for t in range(n)]
    df = table(spark, rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert trie_rows(trie.conversation_trie(df)) == nodes_of(rows)


def test_long_conversation_is_numbered_in_shares(spark):
    rows = [(1, t, "user", str(t)) for t in range(5000)] + [(2, t, "user", str(t)) for t in range(3)]
    placed = trie.numbered_turns(table(spark, rows, "conv_id long, turn long, role string, text string").repartition(4))
    assert sorted((r.c, r.d) for r in placed.collect()) == sorted((c, t + 1) for c, t, *_ in rows)


def test_trie_equals_sql(spark, duck):
    got = trie_rows(trie.conversation_trie(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert got == sorted(duck.sql(f"select {', '.join(COLUMNS)} from ({oracles.PREFIX_TRIE})").fetchall())
    assert trie.conversation_trie(table(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_end_pieces_stream(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    ends = table(spark, [(i % 2, 4, i) for i in range(100)], "conv_id long, depth long, c long")
    got = {r.conv_id: r.ends_sha256 for r in trie.end_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(100) if i % 2 == k).encode()).hexdigest() for k in (0, 1)}
