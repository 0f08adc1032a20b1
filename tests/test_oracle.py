"""Every registered query next to its SQL, on the smallest tables."""

import pytest

import oracle
from plumbline.showcase import registry

SMALL = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SMALL)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    message, *_ = oracle.compare(spark, con, name, SMALL, registry.queries()[name], SQL.get(name))
    assert message is None, message
