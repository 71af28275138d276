"""Every registered query of the archive engine against DuckDB on the same tables."""

import pytest

from palimpsest.plans import MODULES

from .conftest import SF

ORACLES, QUERIES = ({k: v for m in MODULES for k, v in getattr(m, name).items()} for name in ("ORACLES", "QUERIES"))


def norm(x):
    return round(x, 6) if isinstance(x, float) else x


def test_names_are_of_one_module():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == columns
    want = sorted((tuple(norm(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want
