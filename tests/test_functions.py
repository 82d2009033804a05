from pyspark.sql import functions as F

from loomspark.functions import names as N
from loomspark.functions import sqltext as T
from loomspark.functions import timefmt as TF
from loomspark.functions import types as TY


def _one(spark, col, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_normalise_name_edges(spark):
    rows = [("foo_v2_",), ("a.b.sql",), (".sql",), ("Foo-Bar_V3.sql",), ("dir/My File_v12.py",), ("x__y",), ("",)]
    got = _one(spark, N.normalise_name("x"), rows)
    # foo_v2_ : the version suffix is only stripped at the very end, before '_' trimming
    assert got == ["foo_v2", "a_b", "sql", "foo_bar", "my_file", "x_y", ""]


def test_normalise_name_override(spark):
    df = spark.createDataFrame([("a.sql", "custom"), ("b.sql", None)], "x string, o string")
    assert [r[0] for r in df.select(N.normalise_name("x", "o")).collect()] == ["custom", "b"]


def test_safe_table_name(spark):
    df = spark.createDataFrame([("Mapping", "My Sheet (v2)"), ("__a", "b__")], "f string, s string")
    assert [r[0] for r in df.select(N.safe_table_name("f", "s")).collect()] == ["mapping_my_sheet_v2", "a_b"]


def test_path_parts(spark):
    rows = [("a/b/c.tar.gz",), ("dir/",), (".bashrc",), ("foo.",)]
    assert _one(spark, N.path_stem("x"), rows) == ["c.tar", "dir", ".bashrc", "foo."]
    assert _one(spark, N.subfolder("x"), [("a\\b\\c.py",), ("c.py",), (None,)]) == ["a/b", "", ""]


def test_duration_and_formats(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-01T00:01:30.5Z"), ("bad", "2024-01-01"),
                                (None, "2024-01-01")], "s string, e string")
    got = [r[0] for r in df.select(TF.duration_seconds("s", "e", parse=True)).collect()]
    assert got == [90.5, None, None]
    assert _one(spark, TF.fmt_duration("x"), [(None,), (59.9,), (60.0,), (3725.2,)], "x double") == \
        ["", "59s", "1m 0s", "62m 5s"]
    assert _one(spark, TF.fmt_size("x"), [(None,), (1023,), (1280,), (1024 * 1024 * 3,)], "x long") == \
        ["—", "1023 B", "1.3 KB", "3.0 MB"]


def test_type_map_and_status(spark):
    rows = [("int",), (" VARCHAR ",), ("varchar(20)",), ("geometry",), ("",)]
    assert _one(spark, TY.source_to_target_type("x"), rows) == ["INT64", "STRING", "VARCHAR(20)", "GEOMETRY", ""]
    df = spark.createDataFrame([(True, True, "INT64", "INTEGER"), (True, True, "NUMERIC", "STRING"),
                                (False, True, "", "INT64"), (True, False, "INT64", ""), (True, True, "", "X")],
                               "s boolean, t boolean, e string, a string")
    got = [r[0] for r in df.select(TY.audit_status("s", "t", "e", "a")).collect()]
    assert got == ["Match", "Type Mismatch", "Target Only", "Source Only", "Match"]


def test_health_defaults(spark):
    df = spark.createDataFrame([(100.0, 0.95), (300.0, 0.95), (100.0, 0.8), (600.0, 1.0), (1.0, 0.69)],
                               "a double, r double")
    got = [r[0] for r in df.select(TY.health_status("a", "r")).collect()]
    assert got == ["healthy", "warning", "warning", "critical", "critical"]


def test_truncated_repr_forms(spark):
    sql = "SELECT a, b FROM ds.table_one WHERE x = 1"
    forms = [
        "Truncated. {\\'query\\': {\\'query\\': \\'" + sql.replace("'", "\\'") + "\\', \\'x\\': 1}}\\'...",
        "Truncated. {'query': {'query': '" + sql + "'...",
        'Truncated. {"query": {"query": "' + sql + '"...',
        "Not truncated 'query': '" + sql + "'",
    ]
    got = _one(spark, T.salvage_truncated_sql("x"), [(f,) for f in forms])
    assert got[1] == sql and got[2] == sql
    assert got[0].startswith(sql)
    assert got[3] is None


def test_extract_sql_recursive(spark):
    docs = ['{"sql": {"inner": "   SELECT * FROM deep.table WHERE 1=1  "}}',
            '{"configuration": {"query": {"query": "WITH a AS (SELECT 1) SELECT * FROM a"}}, "sql": "short"}',
            '{"a": [1, {"b": "INSERT INTO t SELECT * FROM s"}]}',
            '{"configuration": "SELECT * FROM hidden_in_configuration_string"}',
            'not json']
    got = _one(spark, T.extract_sql("x"), [(d,) for d in docs])
    assert got == ["SELECT * FROM deep.table WHERE 1=1", "WITH a AS (SELECT 1) SELECT * FROM a",
                   "INSERT INTO t SELECT * FROM s", None, None]
    fixed = _one(spark, T.extract_sql_paths("x"), [(d,) for d in docs])
    assert fixed[0] is None and fixed[1] == "WITH a AS (SELECT 1) SELECT * FROM a"


def test_best_sql(spark):
    df = spark.createDataFrame([("raw", "rendered!", True), ("raw", "rendered!", False), ("rawer", "short", False),
                                (None, "r", False), ("", None, True)], "a string, b string, t boolean")
    assert [r[0] for r in df.select(T.best_sql("a", "b", "t")).collect()] == ["raw", "rendered!", "rawer", "r", ""]


def test_whitespace_and_header(spark):
    got = _one(spark, T.normalise_whitespace("x"), [("a b​c d e",)])
    assert got == ["a bc\nd\ne"]
    df = spark.createDataFrame([("  /* hdr */\n\nSELECT 1",), ("SELECT 2",)], "x string")
    got = df.select(T.split_header_comment("x").alias("h")).select("h.header", "h.body").collect()
    assert (got[0][0], got[0][1]) == ("  /* hdr */", "SELECT 1")
    assert (got[1][0], got[1][1]) == ("", "SELECT 2")


def test_split_tags_and_uri(spark):
    assert _one(spark, F.array_join(N.split_tags("x"), "|"), [(" a, b ,,c ",), (None,)]) == ["a|b|c", ""]
    df = spark.createDataFrame([("gs://bucket/a/b/",), ("bucket",)], "x string")
    got = df.select(N.split_object_uri("x").alias("u")).select("u.bucket", "u.prefix").collect()
    assert [tuple(r) for r in got] == [("bucket", "a/b"), ("bucket", "")]


def test_durations_ignore_session_zone(spark):
    import datetime as dt
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 3, 30))],
                                   "s timestamp_ntz, e timestamp_ntz")
        assert df.select(TF.duration_seconds("s", "e")).first()[0] == 7200.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_recommended_conf():
    from loomspark.session import recommended_conf
    conf = recommended_conf(100 * (1 << 40), 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600


def test_extract_sql_escapes(spark):
    docs = ['{"x": "a\\nSELECT * FROM escaped_table_one"}',
            '{"x": "\\u0053ELECT * FROM unicode_escaped_table"}',
            '{"sql": "  SELECT a FROM fast_path_table  ", "other": "INSERT INTO never_reached t"}',
            '{"bash": "echo hello world, nothing to see here"}',
            '"SELECT * FROM a_top_level_string_doc"']
    got = _one(spark, T.extract_sql("x"), [(d,) for d in docs])
    assert got == ["a\nSELECT * FROM escaped_table_one", "SELECT * FROM unicode_escaped_table",
                   "SELECT a FROM fast_path_table", None, "SELECT * FROM a_top_level_string_doc"]
