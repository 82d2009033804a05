import pytest

from loomspark.plans.sqlapi import ReadOnlyViolation, check_read_only, run_sql


@pytest.mark.parametrize("sql", [
    "INSERT INTO t VALUES (1)", "drop table t", "/* hi */ DROP TABLE t", "-- c\nDELETE FROM t",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT 1; DROP TABLE t", "CREATE VIEW v AS SELECT 1",
    "SET spark.sql.x=1", "MERGE INTO t USING s ON 1=1", "select 1 union all select 2; select 3",
    "CACHE TABLE t", "ALTER TABLE t ADD COLUMN x INT", "", "SELECT (",
    r"WITH x AS (SELECT r'\' AS a) INSERT INTO t SELECT * FROM x -- '", "FROM a INSERT INTO t SELECT *",
    r"WITH x AS (SELECT R\"\" AS a) INSERT INTO t SELECT * FROM x -- \"",
    "/* a /* nested */ b */ INSERT INTO t SELECT 1", "SELECT reflect('java.lang.System', 'exit', 0)",
    "SELECT `java_method`('java.lang.Runtime', 'getRuntime')", "SELECT r'\\', try_reflect ('a', 'b')",
    "SELECT TRANSFORM(a) USING 'cat' FROM t", "DESCRIBE t", "EXPLAIN SELECT 1", "USE db",
    "SELECT 1 AS `'`, reflect('java.lang.System','getProperty','java.version') AS `x'`",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.version')",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'java.version') FROM t",
    "EXECUTE IMMEDIATE 'CREATE TEMP VIEW zz AS SELECT 1'", "EXECUTE IMMEDIATE 'SELECT 1'",
    "SELECT * FROM t WHERE a IN (SELECT reflect('a', 'b'))", "SELECT system.builtin.Reflect('a', 'b')",
    "WITH x AS (SELECT reflect('a', 'b') y) SELECT * FROM x", "SELECT filter(a, x -> java_method('a', 'b') > 1) FROM t",
    "SELECT * FROM t JOIN LATERAL (SELECT reflect('a', 'b'))", "SELECT CASE WHEN EXISTS (SELECT try_reflect('a', 'b')) THEN 1 END",
    "SELECT max(reflect('a', 'b')) OVER (PARTITION BY java_method('c', 'd')) FROM t", "VALUES (reflect('a', 'b'))",
    "SELECT 1 ORDER BY reflect('a', 'b')", "SELECT a FROM t LATERAL VIEW reflect('a', 'b') c AS d", "SELECT * FROM reflect('a', 'b')",
    "FROM t |> WHERE reflect('a', 'b') = 1", "CALL x.y()", "SHOW TABLES", "BEGIN SELECT 1; END", "SET VAR x = 1",
    "SELECT * FROM t PIVOT (max(reflect('a', 'b')) FOR b IN (1))", "SELECT * FROM IDENTIFIER('t')",
])
def test_rejects_writes(spark, sql):
    with pytest.raises(ReadOnlyViolation):
        check_read_only(sql)


@pytest.mark.parametrize("sql", [
    "SELECT 'drop table x' AS s", "-- comment\nSELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a",
    "SELECT load, set, add FROM metrics", "SELECT 'reflect(1)' AS s -- reflect(", "SELECT * FROM (WITH a AS (SELECT 1) SELECT * FROM a)",
    "SELECT reflect, `java_method` FROM t", "SELECT 1 AS `reflect('x')`", "SELECT a FROM t LATERAL VIEW explode(b) c AS d",
    "SELECT * FROM t TABLESAMPLE (10 PERCENT) x", "FROM t |> WHERE a > 1 |> SELECT a", "SELECT /*+ broadcast(t) */ * FROM t",
    "SELECT a, grouping_id() FROM t GROUP BY CUBE (a, b) HAVING sum(c) > 1", "VALUES (rand(), current_date())",
    "SELECT sum(a) OVER w FROM t WINDOW w AS (PARTITION BY b)", "SELECT * FROM t PIVOT (sum(a) FOR b IN (1, 2))",
    "SELECT * FROM t UNPIVOT (v FOR n IN (a, b))", "SELECT * FROM t JOIN LATERAL (SELECT t.a + 1)", "TABLE t",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", "SELECT * FROM t DISTRIBUTE BY a",
    "VALUES (1), (2)", "(SELECT 1)", "SELECT replace('a', 'a', 'b');", "FROM range(3) SELECT id",
])
def test_allows_reads(spark, sql):
    check_read_only(sql)


def test_run_sql_on_views(spark, sf):
    from loomspark.sources.tables import register_tables
    register_tables(spark, sf, ["region"])
    assert run_sql(spark, "SELECT count(*) AS n FROM region").first()["n"] == 5


def test_refused_statements_have_no_effect(spark):
    with pytest.raises(ReadOnlyViolation):
        run_sql(spark, "EXECUTE IMMEDIATE 'CREATE TEMP VIEW made_by_execute AS SELECT 1'")
    assert not spark.catalog.tableExists("made_by_execute")
