"""Every registered query against its SQL counterpart, on the smallest data set."""

import os

import pytest

import __spark_entry__
from checks import inputs
from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert unwanted not in plan
    assert difference(df, db, ORACLE[name]) is None


@pytest.mark.parametrize("made", [inputs.expressions, inputs.results])
def test_costly_rows_are_dealt_out(spark, made):
    assert made(spark, SF_DIR).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_results_are_parsed_once_and_behind_the_exchange(spark):
    plan = QUERIES["metric_choice"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "(size(" not in plan
    below = plan[plan.index("Repartition") :]
    assert "RLIKE" not in below and "StructsToJson" not in below


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
