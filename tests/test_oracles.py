"""Every registered query with a SQL twin gives the twin's rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, connect  # noqa: E402

from tablewright.catalog import all_queries  # noqa: E402

TWINS = [q for q in all_queries() if q.sql is not None]


@pytest.fixture(scope="session")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("query", TWINS, ids=lambda q: q.name)
def test_twin(spark, con, folder, query):
    text, ok = compare(spark, con, query, folder)
    assert ok, text


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names
    assert len(names) > 80
