import random

from pyspark.sql import functions as F

from loomspark.operators import audit as A
from loomspark.operators import lineage as L


def test_audit_missing_target_and_null_prod(spark):
    meta = spark.createDataFrame([("t1", "a", 1, "int", None), ("t1", "b", 2, "varchar", None),
                                  ("t2", "x", 1, "int", 1), ("t2", "x", 3, "bigint", 1)],
                                 "table_name string, column_name string, ordinal_position long, data_type string, "
                                 "deployed_to_prod int")
    target = spark.createDataFrame([("t2", "x", 1, "INTEGER", None), ("t2", "y", 2, "STRING", "d"),
                                    ("t9", "z", 1, "STRING", "")],
                                   "table_name string, column_name string, ordinal_position long, data_type string, "
                                   "description string")
    out = {(r["table_name"], r["column_name"]): r for r in A.schema_audit(meta, target).collect()}
    assert out[("t1", "a")]["status"] == "Source Only" and out[("t1", "a")]["batch"] == "uat"
    assert out[("t2", "x")]["status"] == "Match" and out[("t2", "x")]["source_ordinal"] == 3  # last wins
    assert out[("t2", "y")]["status"] == "Target Only" and out[("t2", "y")]["batch"] == "prod"
    assert ("t9", "z") not in out  # target tables outside the audit are ignored
    s = {r["batch"]: r for r in A.audit_summary(A.schema_audit(meta, target)).collect()}
    assert s["uat"]["source_only"] == 2 and s["prod"]["match_pct"] == 50.0


def test_short_labels(spark):
    names = spark.createDataFrame([("a" * 40,), ("a" * 31 + "b",), ("x:y",), ("Summary",)], "table_name string")
    got = {r["table_name"]: r["label"] for r in A.short_unique_labels(names).collect()}
    # ordered by name: "a"*40 sorts before "a"*31 + "b", so it keeps the plain label
    assert got["a" * 40] == "a" * 31 and got["a" * 31 + "b"] == "a" * 29 + "_2"
    assert got["x:y"] == "x_y" and got["Summary"] == "Summary_2"


def test_leaf_profile_nested(spark):
    df = spark.createDataFrame([(1, (2, (3, None)), [1])], "id long, s struct<a:int,b:struct<c:int,d:string>>, r array<int>")
    rows = {r["path"]: r for r in A.leaf_profile(df).collect()}
    assert set(rows) == {"id", "s.a", "s.b.c", "s.b.d", "r"}
    assert rows["s.b.d"]["non_null"] == 0 and rows["r"]["mode"] == "REPEATED"
    assert A.flatten_columns(df).columns == ["id", "s.a", "s.b.c", "s.b.d", "r"]


def test_leaves_inside_arrays(spark):
    df = spark.createDataFrame(
        [(1, [(1, [(None,), ("x",)]), (None, None), None], [[(1.0,)], [], None, [(None,), (2.0,)]], {"k": 1}),
         (2, None, None, None), (3, [], [], None)],
        "`a.id` long, arr array<struct<`it's`:int, sub:array<struct<b:string>>>>, deep array<array<struct<v:double>>>, "
        "m map<string,int>")
    got = [(r["path"], r["type"], r["mode"], r["non_null"], r["row_count"]) for r in A.leaf_profile(df).collect()]
    assert got == [("a.id", "bigint", "NULLABLE", 3, 3), ("arr.it's", "int", "REPEATED", 1, 3),
                   ("arr.sub.b", "string", "REPEATED", 1, 3), ("deep.v", "double", "REPEATED", 2, 3), ("m", "map<string,int>", "NULLABLE", 1, 3)]
    assert A.flatten_columns(df).columns == ["a.id", "arr", "deep", "m"]
    assert [r["non_null"] for r in A.leaf_profile(df.limit(0)).collect()] == [0] * 5


def test_depth_cycle_terminates(spark):
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "b"), ("d", "x", "y"), ("d", "y", "x")],
                                  "dag_id string, src string, dst string")
    nodes = spark.createDataFrame([("d", n) for n in "abcxy"], "dag_id string, task_id string")
    got = {r["task_id"]: r["depth"] for r in L.task_depth(edges, nodes).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}  # x, y only on a cycle: unreachable from a root


def test_roots_and_graph(spark):
    tasks = spark.createDataFrame([("d", "a", "EmptyOperator", ["b", "c"], None, None),
                                   ("d", "b", "TriggerDagRunOperator", [], "child", None),
                                   ("d", "c", "BigQueryInsertJobOperator", [], None, "select 1")],
                                  "dag_id string, task_id string, operator string, downstream_task_ids array<string>, "
                                  "trigger_dag_id string, sql string")
    assert [r["task_id"] for r in L.root_tasks(tasks).collect()] == ["a"]
    assert [tuple(r) for r in L.child_dag_edges(tasks).collect()] == [("d", "child")]
    kinds = {r["kind"] for r in L.lineage_edges(spark.createDataFrame([("wb", ["d"])], "raw_name string, dag_names array<string>"), tasks).collect()}
    assert kinds == {"excel_dag", "dag_task", "task_task", "task_sql"}


def test_lookup_first_brute_force(spark):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "ab", "a", "zz", "mapping", "Master"]
    reg = [(i, f"{rnd.choice(words)}_{rnd.choice(words)}", f"/d/{rnd.choice(words)}/{rnd.choice(words)}.xlsx")
           for i in range(60)]
    needles = ["a", "AB", "ta_g", "master", "zzz", "pp", "x", "/d/"]
    rdf = spark.createDataFrame(reg, "pos long, table_name string, file_path string")
    ndf = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = {r["needle"]: r["pos"] for r in L.lookup_first(rdf, ndf).collect()}
    for n in needles:
        want = next((p for p, t, f in sorted(reg) if n.lower() in (f + "\u0001" + t).lower()), None)
        assert got[n] == want, n


def test_mapping_lookup_fallback(spark):
    entries = spark.createDataFrame([("/x/Sheet A.xlsx", "own"), ("/x/other.xlsx", "own2"), ("/x/MIXED.xlsx", None)],
                                    "file_path string, bq_table string")
    config = spark.createDataFrame([("Sheet A", "", ["d1"]), ("mixed", "t.m", None)],
                                   "stem string, bq_table string, dag_names array<string>")
    out = {r["file_path"]: r for r in L.mapping_lookup(entries, config).collect()}
    assert out["/x/Sheet A.xlsx"]["bq_table"] == "own" and out["/x/Sheet A.xlsx"]["dag_names"] == ["d1"]
    assert out["/x/MIXED.xlsx"]["bq_table"] == "t.m" and out["/x/MIXED.xlsx"]["dag_names"] == []
    assert out["/x/other.xlsx"]["bq_table"] == "own2"


def test_trigger_target_sources(spark):
    df = spark.createDataFrame([
        ("TriggerDagRunOperator", "direct", None, None),
        ("TriggerDagRunOperator", None, '{"trigger_dag_id": "from_conf"}', None),
        ("TriggerDagRunOperator", None, None, '{"trigger_dag_id": {"value": "from_params"}}'),
        ("BashOperator", "ignored", None, None)], "op string, t string, conf string, params string")
    got = [r[0] for r in df.select(L.trigger_target("op", "t", "conf", "params")).collect()]
    assert got == ["direct", "from_conf", "from_params", None]


def test_depth_recursive_cycle(spark):
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "b"), ("d", "a", "c")],
                                  "dag_id string, src string, dst string")
    nodes = spark.createDataFrame([("d", n) for n in "abc"], "dag_id string, task_id string")
    got = {r["task_id"]: r["depth"] for r in L.task_depth_recursive(edges, nodes).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}
    assert got == {r["task_id"]: r["depth"] for r in L.task_depth(edges, nodes).collect()}


def test_audit_names_are_case_sensitive(spark):
    meta = spark.createDataFrame([("t", "Amount", 1, "decimal", 1)],
                                 "table_name string, column_name string, ordinal_position long, data_type string, "
                                 "deployed_to_prod int")
    target = spark.createDataFrame([("t", "amount", 1, "NUMERIC", "")],
                                   "table_name string, column_name string, ordinal_position long, data_type string, "
                                   "description string")
    got = {r["column_name"]: r["status"] for r in A.schema_audit(meta, target).collect()}
    assert got == {"Amount": "Source Only", "amount": "Target Only"}


def test_listing_order_and_tag_search(spark):
    from loomspark.operators import catalog, stores
    objs = spark.createDataFrame([("b", "Zeta.txt", 5), ("b", "alpha/x.sql", 3), ("b", "Beta/y.sql", 4),
                                  ("b", "beta.txt", 1), ("b", "alpha/z/w.sql", 2)], "bucket string, path string, size long")
    got = [(r["name"], r["type"], r["objects"]) for r in catalog.folder_listing(objs).collect()]
    assert got == [("alpha/", "dir", 2), ("Beta/", "dir", 1), ("beta.txt", "file", 1), ("Zeta.txt", "file", 1)]
    q = spark.createDataFrame([(1, "n1", "select 1", "user", None, ["Lang_1", "T0"]),
                               (2, "n2", "select 2", "user", "desc", ["Other"])],
                              "id long, name string, sql string, source string, description string, tags array<string>")
    assert [r["id"] for r in stores.search_queries(q, text="Lang").collect()] == []      # tags keep their case
    assert [r["id"] for r in stores.search_queries(q, text="ANG_1").collect()] == [1]
    assert [r["id"] for r in stores.search_queries(q, text="DESC").collect()] == [2]    # null description is fine
