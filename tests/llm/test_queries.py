import os

import pytest

from phrasegrid.llm import queries, sql

from ..compare import DATA, check_plan, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, queries.queries()[name], sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    check_plan(df)
    df.write.format("noop").mode("overwrite").save()
