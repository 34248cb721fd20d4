import pytest
from oracle import hold

from sievework.plans import oracles, oracles_curation, oracles_more, queries, queries_curation, queries_more

QUERIES = queries.QUERIES | queries_more.QUERIES | queries_curation.QUERIES
SQL = oracles.SQL | oracles_more.SQL | oracles_curation.SQL


def test_every_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_like_sql(spark, name):
    hold(spark, QUERIES[name], SQL[name])
