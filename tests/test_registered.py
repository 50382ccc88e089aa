"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import os

import pytest

import __spark_entry__ as entry
import agree
from trellium.plans import book

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")

# What no plan may hold: row-at-a-time or batch Python, and joins without a key.
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    return agree.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(book.QUERIES))
def test_query(spark, con, name):
    def checked(session, sf_dir):
        frame = book.QUERIES[name](session, sf_dir)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not [node for node in FORBIDDEN if node in plan]
        return frame

    text, _ = agree.difference(spark, con, name, checked, book.SQL.get(name), SF_DIR)
    assert not text


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns and frame.count() > 0


def test_every_query_has_sql():
    assert set(book.QUERIES) == set(book.SQL)
    assert set(entry.queries()) >= set(book.QUERIES) and set(entry.oracle_sql()) >= set(book.SQL)
