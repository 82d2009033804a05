"""Short statements stay in their rows; long ones follow the same rules over the scope table."""
import pytest

from loomspark.operators import sqlscopes
from loomspark.operators import textjobs as TJ

from test_sqlscopes import FLAGS, OBJECTS


def test_short_statements_are_not_sorted(spark):
    df = spark.createDataFrame([(1, "SELECT f(a) FROM t, u")], "stmt_id int, sql string")
    scopes = sqlscopes.statement_scopes(sqlscopes.by_length(df, "sql")[0], "sql", ["stmt_id"])
    for out in (sqlscopes.scope_facts(scopes, ["x"], ["stmt_id"]), sqlscopes.scope_objects(scopes, ["stmt_id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 1 and "Sort" not in plan and "Window" not in plan, plan
        assert plan.count("aggregate(concat(filter(") == 1, plan  # the fold over parentheses is worked out once


@pytest.mark.parametrize("most", [0, 60])
def test_both_ways_agree(spark, monkeypatch, most):
    texts = [s for s, _ in FLAGS + OBJECTS] + ["SELECT a) FROM t ( , u", "a) b (FROM c) WHERE f(x) (", "((FROM a SELECT"]
    df = spark.createDataFrame(list(enumerate(texts)), "stmt_id int, sql string").repartition(2)
    both = lambda: [sorted(map(tuple, d.collect())) for d in (TJ.sql_flags(df), TJ.object_access(df, group="stmt_id"))]
    in_rows = both()
    monkeypatch.setattr(sqlscopes, "SHORT", most)
    assert both() == in_rows
