"""Golden cases of state resolution: boundaries, restores, conflicts of three values."""

from datetime import datetime

import pytest

from palimpsest.operators import state
from palimpsest.sources import archive

T = [datetime(2024, 1, d) for d in range(1, 10)]
V = "corpus_id string, doc_id long, version_id long, version_number int, predecessor_id long, event string, observed_at timestamp"
C = "claim_id string, corpus_id string, doc_id long, version_id long, version_number int, observed_at timestamp, key string, val int, claim string, valid_from timestamp, valid_until timestamp, supersedes_id string"


@pytest.fixture(scope="module")
def tables(spark):
    v = [("c", 1, 10, 1, None, "NEW", T[0]), ("c", 1, 11, 2, 10, "MODIFIED", T[1]), ("c", 2, 20, 1, None, "NEW", T[0]), ("c", 3, 30, 1, None, "NEW", T[0]), ("c", 3, 31, 2, 30, "DELETED", T[2]), ("c", 4, 40, 1, None, "NEW", T[0])]
    c = [
        ("a", "c", 1, 10, 1, T[0], "k", 1, "k is 1", T[0], None, None),
        ("b", "c", 1, 11, 2, T[1], "k", 2, "k is 2", T[1], None, "a"),
        ("d", "c", 2, 20, 1, T[0], "k", 3, "k is 3", T[0], T[5], None),
        ("e", "c", 3, 30, 1, T[0], "k", 4, "k is 4", T[0], None, None),
        ("f", "c", 4, 40, 1, T[0], "l", 4, "l is 4", T[0], T[5], None),
    ]
    return spark.createDataFrame(v, V), spark.createDataFrame(c, C)


def status(tables, as_of, valid_at=None):
    return {r.claim_id: r.status for r in state.resolve(*tables, as_of, valid_at).collect()}


def test_conflict_of_three_then_deletion(tables):
    assert status(tables, "2024-01-02") == {"a": "SUPERSEDED", "b": "CONFLICTING", "d": "CONFLICTING", "e": "CONFLICTING", "f": "CURRENT"}
    assert status(tables, "2024-01-03")["e"] == "UNCERTAIN"


def test_window_is_half_open(tables):
    assert status(tables, "2024-01-09", "2024-01-06")["f"] == "UNCERTAIN"
    assert status(tables, "2024-01-09", "2024-01-05 23:59:59")["f"] == "CURRENT"
    assert status(tables, "2024-01-09", "2024-01-06")["b"] == "CURRENT"  # the other side's window is over


def test_retired_follows_the_cutoff(tables):
    assert status(tables, "2024-01-01")["a"] == "CONFLICTING"


def test_no_cutoff_equals_a_late_one(spark, tables):
    assert status(tables, "2024-01-09") == status(tables, "2999-01-01", "2024-01-09")


def test_stray_deletes_leave_no_trace(spark):
    rows = [(1, T[0], 1, "DELETED"), (1, T[1], 2, "x"), (1, T[2], 3, "x"), (1, T[3], 4, "DELETED"), (1, T[4], 5, "DELETED"), (1, T[5], 6, "x")]
    w = spark.createDataFrame([(*r, r[1].date(), None, None, None, None) for r in rows], "user_id long, observed_at timestamp, version_id long, fp string, d date, v_view int, v_click int, v_signup int, v_purchase int")
    got = [(r.version_id, r.version_number, r.event) for r in archive.lifecycle(w).orderBy("version_id").collect()]
    assert got == [(2, 1, "NEW"), (4, 2, "DELETED"), (6, 3, "RESTORED")]


def test_empty_archive(tables):
    v, c = tables
    assert state.resolve(v.limit(0), c.limit(0), "2024-01-05").count() == 0
