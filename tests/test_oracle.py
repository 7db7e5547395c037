"""Every query of the library against its SQL on the smallest data."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from quarterline.workload.oracle import ORACLE
from quarterline.workload.queries import QUERIES
from tests.oracle_check import connect, differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, SF_DIR), connection, ORACLE[name]) == []


def test_comparison_notices_a_changed_value(spark, connection):
    df = queries()["distinct_pairs"](spark, SF_DIR)
    assert differences(df.limit(3), connection, oracle_sql()["distinct_pairs"])
    assert differences(
        df.replace("Supplier#000000003", "x", "mech_name"), connection, oracle_sql()["distinct_pairs"])


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) and set(QUERIES) <= set(queries())


def test_entry_is_lazy_and_has_rows(spark):
    df = entry(spark)
    assert df.columns[:3] == ["mod_type", "mech_name", "period"] and df.count() > 0
