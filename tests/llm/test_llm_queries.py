import pytest

from oracle import duck, rows
from quillstone.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert rows(Q.queries()[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir, Q.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    assert df.count() > 0
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()
