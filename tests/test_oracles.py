"""Every registered oracle against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import close, duck, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want_names, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got_names == want_names
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(close(a, b) for a, b in zip(g, w)), (g, w)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
