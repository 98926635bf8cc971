"""Every llm query: against its SQL twin, or that it runs."""

import pytest

from ontoloom.llm import queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(name, spark, data, duck):
    same(queries.QUERIES[name](spark, data), duck, queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(name, spark, data):
    assert queries.QUERIES[name](spark, data).count() > 0
