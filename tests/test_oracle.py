"""Every query with SQL gives the same rows in another engine; the others run."""

import pytest
from oracle import connect, difference

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert difference(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
