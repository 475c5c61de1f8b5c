"""Every query of the core runs; those with SQL give the rows that SQL gives."""

import os

import pytest
from comparing import DATA, both
from quern.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    ours, theirs = both(spark, registry.QUERIES[name], registry.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
