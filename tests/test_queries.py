"""Every named query runs, and agrees with its SQL twin where it has one."""

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_a_row_per_column(spark):
    assert entry.entry(spark).count() == 11


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None
    assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0
