"""Every registered query against its SQL, and rules for all of their plans."""

import pytest
from conftest import FOLDER

import __spark_entry__ as entry
from cdclake.checks.registry import load
from check_oracle import compare, connect

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, db, name):
    assert name in SQL
    assert compare(spark, db, FOLDER, name, QUERIES[name], SQL[name]) is None


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_all_are_registered():
    assert QUERIES.items() <= entry.queries().items()
    assert SQL.items() <= entry.oracle_sql().items()


# Those by change have done their work when the plan, a read of files, is there to look at.
BY_CHANGE = ("_by_change", "_by_batches")


@pytest.mark.parametrize("name", [n for n in QUERIES
                                  if n[0] not in "rkx" and not n.endswith(BY_CHANGE)])
def test_plan_stays_in_the_jvm_without_cross_joins(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
