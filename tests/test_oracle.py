"""Every registered query agrees with its SQL over the same tables."""

import pytest

import oracle
from freshet.cases.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.columns and df.count() >= 0
        return
    assert oracle.compare(df, con, ORACLES[name]) is None
