"""The registered training-data queries: their SQL, and plans of those that use built-in functions only."""

import os

import pytest

from quarterline.llm.queries import ORACLE, QUERIES
from tests.oracle_check import connect, differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NATIVE = ("op1_perspective_rotation", "op2_imatch_fingerprints", "op3_rule_bitmask_ledger", "op10_markov_secret_scan")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, SF_DIR), connection, ORACLE[name]) == []


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_have_no_python(spark, name):
    text = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"):
        assert word not in text
