"""Physical plans: no pairwise joins, columns and filters reach the scan."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
QUERIES = entry.queries()


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"hawkes_fit", "hawkes_multivariate", "forest_oof", "forest_importance", "forest_assignment", "combined_forest"}))
def test_no_pairwise_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_needed_columns_only(spark):
    text = plan(spark, "asof_state")
    reads = [line for line in text.splitlines() if "ReadSchema" in line]
    assert reads and all("value:double" not in line for line in reads)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan(spark, "isolation").replace("\n", " ")


def test_windows_share_one_exchange(spark):
    """All passes of the clock check run on one shuffle of the rows."""
    assert plan(spark, "clock_qc").count("Exchange hashpartitioning") == 1
