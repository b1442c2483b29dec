"""The registered contracts against their SQL."""

import oracle
import pytest

from ferrule.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_oracle(name, spark, sf_dir):
    ok, said = oracle.same(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name])
    assert ok, said
