"""The queries of the subpackage over whole tables."""

import pytest
from helpers import same_as_sql

from siltstone.llm.oracle import ORACLE
from siltstone.llm.registry import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, small, name):
    same_as_sql(QUERIES[name](spark, small), ORACLE[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    n = df.count()
    assert n > 0
    if name.endswith("_found"):
        assert df.distinct().count() == n
