"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import pytest
from conftest import SMALL
from oracle import compare, connect

from strataflux.plans import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], SMALL) is None


def test_names_match():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
