"""Every core query against its SQL on the smallest tables."""

import pytest

from oracle import duck, rows
from quillstone.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir, SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns[0] == "level"
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(__file__).parents[1]
    for f in root.joinpath("quillstone").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
