"""SQL rules over the scope table: expected rows written by hand."""
import pytest

from loomspark.operators import sqlscopes
from loomspark.operators import textjobs as TJ

OBJECTS = [
    ("SELECT 1 FROM ds.a, ds.b WHERE x IN (1, 2)", {"ds.a": "read", "ds.b": "read"}),
    ("SELECT * FROM `p`.`d`.`t1` JOIN `p.d.t2` USING (k), p.d.t3", {"p.d.t1": "read", "p.d.t2": "read", "p.d.t3": "read"}),
    ("INSERT OVERWRITE ds.z SELECT a, b FROM ds.y, ds.x", {"ds.z": "write", "ds.y": "read", "ds.x": "read"}),
    ("INSERT INTO TABLE ds.y (a, b) VALUES (1, 2)", {"ds.y": "write"}),
    ("INSERT ds.q SELECT f(a, b), c FROM ds.r ORDER BY c, d", {"ds.q": "write", "ds.r": "read"}),
    ("UPDATE ds.u SET a = 1, b = 2 FROM ds.v WHERE u.k = v.k", {"ds.u": "write"}),
    ("UPDATE ds.u SET a = (SELECT max(b) FROM ds.v)", {"ds.u": "write", "ds.v": "read"}),
    ("DELETE FROM ds.w WHERE k IN (SELECT k FROM ds.x)", {"ds.w": "write", "ds.x": "read"}),
    ("WITH c AS (SELECT 1 FROM ds.f), d AS (SELECT 2 FROM c) SELECT * FROM d, ds.e", {"ds.f": "read", "ds.e": "read"}),
    ("WITH RECURSIVE c (a, b) AS (SELECT 1, 2 UNION ALL SELECT * FROM C, ds.g) SELECT * FROM c", {"ds.g": "read"}),
    ("MERGE INTO ds.m USING ds.s ON a = b WHEN MATCHED THEN UPDATE SET x = 1 WHEN NOT MATCHED THEN INSERT (a) VALUES (1)",
     {"ds.m": "write"}),
    ("CREATE OR REPLACE TABLE ds.n AS SELECT EXTRACT(YEAR FROM ts), TRIM(BOTH 'x' FROM y) FROM ds.n", {"ds.n": "read/write"}),
    ("CREATE TABLE IF NOT EXISTS `my-proj.ds.o` (a INT64, b STRING)", {"my-proj.ds.o": "write"}),
    ("SELECT a IS DISTINCT FROM b, c FROM my-proj.ds.h h, UNNEST(h.items) i, LATERAL (SELECT 1) j", {"my-proj.ds.h": "read"}),
    ("SELECT * FROM (SELECT * FROM ds.i), ds.j # FROM ds.no\n -- FROM ds.no\n /* , ds.no */", {"ds.i": "read", "ds.j": "read"}),
    ("SELECT 'FROM ds.no', \"JOIN ds.no\", r'\\' FROM ds.k LEFT JOIN ds.l ON f(a, b) = c, ds.m", {"ds.k": "read", "ds.l": "read", "ds.m": "read"}),
    ("TRUNCATE TABLE ds.t", {"ds.t": "write"}), ("SELECT 1", {}), ("", {}), ("FROM ds.first SELECT a", {"ds.first": "read"}),
]


def test_objects_by_hand(spark):
    stmts = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(OBJECTS)] + [(99, None)], "n int, sql string")
    got = {}
    for r in TJ.object_access(stmts, group="n").collect():
        got.setdefault(r["n"], {})[r["object"]] = r["operation"]
    assert [(s, got.get(i, {})) for i, (s, _) in enumerate(OBJECTS)] == OBJECTS and 99 not in got


FLAGS = [
    ("SELECT a FROM t # WHERE x = 1", {"full_table_scan"}),
    ("SELECT a FROM t WHERE x = 1 # c", set()),
    ("SELECT t.* FROM t WHERE x = 1", {"select_star"}),
    ("SELECT a, (b) * c FROM t WHERE x = 2 * (3) * y", set()),
    ("SELECT count( * ) FROM t WHERE x = 1", {"select_star"}),
    ("SELECT a FROM t WHERE a IN (SELECT x FROM u GROUP BY x) AND my_fn(b) = 1", {"non_sargable my_fn"}),
    ("SELECT a FROM t WHERE a = 1 GROUP BY my_fn(a)", set()),
    ("SELECT a FROM (SELECT f1(b) FROM u WHERE f2(c) = 1) WHERE lower(a) = 'x' ORDER BY f3(a)", set()),
    ("SELECT a FROM (SELECT f1(b) FROM u WHERE f2(c) = 1) s JOIN f4(x) y ON f3(a) = 1", {"non_sargable f2"}),
    ("SELECT a FROM t WHERE ds.fn(a) = 1", {"non_sargable fn"}),
    ("SELECT `where` FROM t", {"full_table_scan"}),
    ("this is no statement", {"parse_error"}), ("", {"parse_error"}), ("-- only this", {"parse_error"}),
    ("SELECT (a FROM t", {"parse_error"}), ("SELECT a) FROM t (", {"parse_error"}), ("SELECT 'a FROM t WHERE x = 1", {"parse_error"}),
    ("(SELECT a FROM t WHERE x = 1)", set()),
    ("SELECT \"\"\"it's \"quoted\" WHERE\"\"\" FROM t", {"full_table_scan"}),
]


def test_flags_by_hand(spark):
    stmts = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(FLAGS)] + [(99, None)], "stmt_id int, sql string")
    got = {}
    for r in TJ.sql_flags(stmts).collect():
        name = r["flag_type"]
        if name == "non_sargable":
            name += " " + r["description"].split("'")[1]
        got.setdefault(r["stmt_id"], set()).add(name)
    assert [(s, got.get(i, set())) for i, (s, _) in enumerate(FLAGS)] == FLAGS and 99 not in got


def test_scopes_and_clauses(spark):
    df = spark.createDataFrame([(1, "SELECT f(a, g(b)) FROM (SELECT x FROM t WHERE y) z")], "id int, sql string")
    rows = sqlscopes.scope_table(df, "sql", ["id"]).orderBy("pos").collect()
    assert [(r["token"], r["depth"], r["scope"], r["clause"]) for r in rows] == [
        ("SELECT", 0, -1, "SELECT"), ("f", 0, -1, "SELECT"), ("(", 0, -1, "SELECT"), ("a", 1, 2, None), (",", 1, 2, None),
        ("g", 1, 2, None), ("(", 1, 2, None), ("b", 2, 6, None), (")", 1, 2, None), (")", 0, -1, "SELECT"), ("FROM", 0, -1, "FROM"),
        ("(", 0, -1, "FROM"), ("SELECT", 1, 11, "SELECT"), ("x", 1, 11, "SELECT"), ("FROM", 1, 11, "FROM"), ("t", 1, 11, "FROM"),
        ("WHERE", 1, 11, "WHERE"), ("y", 1, 11, "WHERE"), (")", 0, -1, "FROM"), ("z", 0, -1, "FROM")]


@pytest.mark.parametrize("n", [20_000])
def test_long_statements(spark, n):
    sql = "SELECT " + ", ".join(f"c{i}" for i in range(n)) + " FROM ds.long WHERE " + "(" * 2000 + "1" + ")" * 2000
    df = spark.createDataFrame([(1, sql)], "stmt_id int, sql string")
    assert TJ.sql_flags(df).count() == 0
    assert [r["object"] for r in TJ.object_access(df, group="stmt_id").collect()] == ["ds.long"]
