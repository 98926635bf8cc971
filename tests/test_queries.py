"""Every query that has a SQL twin, on whole small tables."""

import pytest

from ontoloom.plans import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(name, spark, data, duck):
    same(registry.QUERIES[name](spark, data), duck, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, data):
    assert registry.QUERIES[name](spark, data).count() > 0
