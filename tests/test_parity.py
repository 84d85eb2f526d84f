"""Every registered query against its SQL on the smallest data."""

import pytest
from parity import compare, duck

from arborstat import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.callables(), catalog.oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, _ = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert message == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
