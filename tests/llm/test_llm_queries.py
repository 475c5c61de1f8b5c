"""Every query of the subpackage runs; those with SQL give the rows that SQL gives."""

import os

import pytest
from comparing import DATA, both
from quern.llm import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    ours, theirs = both(spark, registry.QUERIES[name], registry.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "quern")):
        for f in files:
            if f.endswith(".py") and f"{os.sep}llm" not in folder:
                assert "quern.llm" not in open(os.path.join(folder, f)).read(), f
