"""Every query against its SQL on the test tables."""

import os

import oracle
import pytest

from eventloom.catalogue import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    rows = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert oracle.difference(rows, duck, ORACLES[name]) == ""
    else:
        rows.collect()


def test_entry_counts_warnings(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["namespace", "reason", "events"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
