"""Read-only SQL entry point over registered tables.

The statement is checked *before* it reaches ``spark.sql``, because Spark runs
commands (DDL/DML) eagerly.  Spark's own parser reads it (parsing executes nothing), and the
parsed plan, with the plans inside its expressions, may hold only nodes of an allow-list: the
parts of queries.  Functions that call arbitrary JVM methods are refused by the last part of their
name, wherever they stand, and so are names that are expressions (``IDENTIFIER(...)``), which no
reader of the plan can check.  No LIMIT is ever added: the caller decides what to collect.
"""
from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: functions that run code of the session's JVM
JVM_CALLS = ("reflect", "java_method", "try_reflect")
# fixed values: the nodes of parsed queries
READS = frozenset((
    "Aggregate", "AsOfJoin", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project", "RelationTimeTravel",
    "Repartition", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "UnresolvedHaving", "UnresolvedHint",
    "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases",
    "UnresolvedTableValuedFunction", "UnresolvedWith", "Union", "Unpivot", "WithWindowDefinition"))


class ReadOnlyViolation(ValueError):
    pass


def _function_name(expr, kind: str) -> str | None:
    """The last part of the name of an unresolved function, generator or table function."""
    if kind == "UnresolvedFunction":
        return expr.nameParts().last()
    if kind == "UnresolvedGenerator":
        return expr.name().funcName()
    if kind == "UnresolvedTableValuedFunction":
        return expr.name().last()
    return None


def check_read_only(sql: str, spark: SparkSession | None = None) -> str:
    """Return the statement (without a trailing ';') or raise ``ReadOnlyViolation``."""
    spark = spark or SparkSession.active()
    stmt = sql.strip()
    while stmt.endswith(";"):
        stmt = stmt[:-1].rstrip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(stmt)
    except ParseException as exc:
        raise ReadOnlyViolation(f"not a single valid statement: {str(exc)[:200]}") from None
    load = spark.sparkContext._jvm.java.lang.Class.forName
    a_plan, a_subquery = (load(f"org.apache.spark.sql.catalyst.{n}", False, plan.getClass().getClassLoader())
                          for n in ("plans.logical.LogicalPlan", "expressions.PlanExpression"))
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        is_plan = a_plan.isInstance(node)
        if is_plan and kind not in READS:
            raise ReadOnlyViolation(f"{kind} is not a read")
        if kind == "ExpressionWithUnresolvedIdentifier":
            raise ReadOnlyViolation("names that are expressions are not allowed")
        name = _function_name(node, kind)
        if name is not None and name.lower() in JVM_CALLS:
            raise ReadOnlyViolation(f"function {name} is not allowed")
        below = [node.children()]
        if is_plan:
            below += [node.expressions()]
            inner = node.innerChildren()
            waiting += [n for n in (inner.apply(i) for i in range(inner.size())) if a_plan.isInstance(n)]
        elif a_subquery.isInstance(node):
            waiting.append(node.plan())
        waiting += [n.apply(i) for n in below for i in range(n.size())]
    return stmt


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Run a read-only query; with no tables registered, an empty result with a note."""
    stmt = check_read_only(sql, spark)
    if not spark.catalog.listTables():
        return spark.createDataFrame([("no tables are registered",)], "note string").limit(0)
    return spark.sql(stmt)


def allow_projects(df: DataFrame, col: str, allowed) -> DataFrame:
    """An empty allow-list allows everything; otherwise membership."""
    allowed = list(allowed or [])
    return df if not allowed else df.where(F.col(col).isin(*allowed))
