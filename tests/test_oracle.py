"""Every registered query against DuckDB on the same tables."""

import os

import compare
import pytest
from cataloom.workload.oracle import ORACLE
from cataloom.workload.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), duck, ORACLE[name]) is None


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() == 200
    assert set(found.columns) == {"path", "ext_category", "category", "score"}
