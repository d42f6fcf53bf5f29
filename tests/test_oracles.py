"""Every query of the core runs, and gives what its SQL gives."""

import compare
import pytest

from framewright.plans import data_queries, reference_queries, reference_sql

QUERIES = reference_queries.QUERIES | data_queries.QUERIES
ORACLES = reference_sql.ORACLES | data_queries.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare.difference(df, ORACLES[name], con) == ""
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert {"video_id", "frame_id", "x1"} <= set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
