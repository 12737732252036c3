"""Every registered query next to its SQL on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    problem = oracle.compare(spark, con, name, QUERIES[name], SQL.get(name), sf)
    # The tiny tables may hold nothing for a query; larger ones are checked with tests/oracle.py.
    assert problem in ("", "no rows on either side")


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_type", "spike_active", "n_rows", "n_errors"]
