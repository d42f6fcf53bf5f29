import pytest

from framewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
