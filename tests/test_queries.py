"""Every registered query against its SQL on the smallest tables; queries without SQL must run and give rows."""

import os

import pytest

from chronolake.plans import registry
from compare import compare, database

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLES:
        assert compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], FOLDER) == ""
    else:
        assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
