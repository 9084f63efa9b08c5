import pytest

import __spark_entry__ as entry
from matloom import queries as engine
from tests.oracle import assert_same, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = engine.queries()[name](spark, FOLDER).toPandas()
    assert_same(got, duck(FOLDER).sql(engine.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert engine.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
