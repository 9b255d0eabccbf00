"""Every registered query against its SQL on the smallest tables, and plan rules."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from workload import ORACLES, QUERIES
from workload.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


# Queries whose plan may hold a single-partition exchange: a global aggregate of one
# pre-aggregated row, or the closed vocabulary list that goes into every prompt.
ONE_ROW = {"domain_rules", "boosted_search", "review_recall", "label_input"}


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("full_scan")))
def test_plans_have_no_cross_join_or_single_task_step(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan
    assert name in ONE_ROW or "SinglePartition" not in plan


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
