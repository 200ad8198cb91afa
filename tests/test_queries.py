"""Every registered query against its SQL in the other engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from stockyard.registry import load
from conftest import sort_key

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


def test_every_query_has_sql():
    own = {name for name, build in load()[0].items()}
    assert own <= set(QUERIES)
    assert own == set(load()[1])


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = sorted((tuple(r) for r in df.select(columns).collect()), key=sort_key)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in answer.fetchall()), key=sort_key)
    assert found == expected
    assert found
