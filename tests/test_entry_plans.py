import pytest

import __spark_entry__ as E
from loomspark.plans.oracles import ORACLES
from loomspark.plans.queries import QUERIES

ROWS_ONLY = {"fingerprint", "folder_diffs", "sql_d18_approx", "reconcile_detail"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["dag_id", "task_id", "avg_duration_s", "max_duration_s", "p95_duration_s",
                          "success_rate", "run_count", "health_status"]


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products(spark, sf, name):
    if name in ("task_depth", "task_structure"):
        pytest.skip("iterative; its joins are equi-joins checked in test_audit_lineage and test_graphs")
    plan = _plan(E.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan
    if name != "sql_d4_range_join":  # the one range join: a fixed four-row band table
        assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["reconcile", "schema_audit", "task_performance", "compare_folders", "sql_flags",
                                  "lint_sources", "run_history", "compare_results", "lookup_first", "trace"])
def test_builtin_operators_stay_in_the_jvm(spark, sf, name):
    plan = _plan(E.queries()[name](spark, sf))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_filters_reach_the_scan(spark, sf):
    plan = _plan(E.queries()["sql_d1_scan_filter"](spark, sf))
    pushed = plan.split("PushedFilters")[1][:300]
    assert "GreaterThanOrEqual(l_ship" in pushed and "IsNotNull(l_quantity)" in pushed


def test_scan_prunes_columns(spark, sf):
    plan = _plan(E.queries()["task_performance"](spark, sf))
    schemas = [seg.split("]")[0] for seg in plan.split("ReadSchema: ")[1:]]
    assert schemas and all("props" not in s for s in schemas)
