import pytest

from loomseq.llm import queries, sql
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_like_sql(spark, sf, con, name):
    more, less = differences(con, sql.oracle_sql()[name], queries.queries()[name](spark, sf))
    assert not more and not less


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0
