import pytest

from tarnweave import queries
from tests.differential import DATA, compare, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", [q for q in queries.oracle_sql() if not (q.startswith("pagerank_") and q.endswith("20") or q.startswith("pagerank_20") or q == "pagerank_converged_topk")] + ["pagerank_20_dangling"])
def test_against_sql(spark, con, name):
    compare(spark, con, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", [q for q in queries.queries() if q not in queries.oracle_sql()])
def test_without_sql(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0
