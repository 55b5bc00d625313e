"""Every query of the engine that SQL can express, against DuckDB on the smallest tables."""

import pytest
from compare import rows
from conftest import SMALL

from tessella import queries as engine


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = rows(engine.QUERIES[name](spark, SMALL).toPandas()), rows(duck.execute(engine.ORACLES[name]).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_runs(spark, name):
    found = engine.QUERIES[name](spark, SMALL)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
