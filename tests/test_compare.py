from pyspark.sql import functions as F

from loomspark.operators import compare as C


def test_shuffled_is_pass(spark, sf):
    from loomspark.sources.tables import read_table
    o = read_table(spark, sf, "orders")
    r = C.compare_results(o, o.orderBy(F.rand(1))).first()
    assert r["status"] == "PASS" and r["only_in_a"] == 0
    assert C.verdict(C.compare_results(o, o)).first()["verdict"] == "SAFE"


def test_duplicate_row_fails(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    r = C.compare_results(a, b).first()
    assert r["status"] == "FAIL" and r["only_in_b"] == 1 and r["only_in_a"] == 0
    d = C.row_diff(a, b).collect()
    assert [(x["side"], x["k"]) for x in d] == [("only_in_b", 2)]


def test_column_mismatch(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("x", 1)], "v string, k int")
    r = C.compare_results(a, b).first()
    assert r["status"] == "FAIL" and not r["columns_match"] and r["only_in_a"] is None
    assert C.verdict(C.compare_results(a, b)).first()["verdict"] == "UNSAFE"


def test_map_columns_are_comparable(spark):
    a = spark.createDataFrame([(1, {"a": 1})], "k int, m map<string,int>")
    assert C.compare_results(a, a).first()["status"] == "PASS"
    assert C.fingerprint(a).first()["row_count"] == 1


def test_no_cartesian(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    plan = C.compare_results(a, a)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_repeated_names_and_maps(spark):
    a, b = spark.sql("SELECT 1 a, 2 a"), spark.sql("SELECT 1 a, 3 a")
    assert C.compare_results(a, a).first()["status"] == "PASS"
    assert C.compare_results(a, b).first()["status"] == "FAIL"
    diff = C.row_diff(a, b)
    assert diff.columns == ["side", "a", "a"] and [tuple(r) for r in diff.collect()] == [("only_in_a", 1, 2), ("only_in_b", 1, 3)]
    assert C.row_diff(a, b, None).columns == ["side", "a", "a", "times"]
    m1 = spark.sql("SELECT map(1, 2, 3, 4) m, named_struct('x', array(map('a', map(1, 2, 3, 4), 'b', map()))) s, 1 `p.q`")
    m2 = spark.sql("SELECT map(3, 4, 1, 2) m, named_struct('x', array(map('b', map(), 'a', map(3, 4, 1, 2)))) s, 1 `p.q`")
    m3 = spark.sql("SELECT map(3, 4, 1, 5) m, named_struct('x', array(map('b', map(), 'a', map(3, 4, 1, 2)))) s, 1 `p.q`")
    assert C.compare_results(m1, m2).first()["status"] == "PASS" and C.row_diff(m1, m2).isEmpty()
    assert C.compare_results(m1, m3).first()["status"] == "FAIL"
    assert C.fingerprint(m1).first() == C.fingerprint(m2).first() != C.fingerprint(m3).first()
    null = spark.sql("SELECT cast(NULL AS struct<m:map<int,int>>) s")
    some = spark.sql("SELECT named_struct('m', cast(NULL AS map<int,int>)) s")
    assert C.compare_results(null, null).first()["status"] == "PASS"
    assert C.compare_results(null, some).first()["status"] == "FAIL"
