"""Cases beyond the stand-ins: unique labels, own DAG names, path listings, corrupt stores, long graphs."""
from pyspark.sql import functions as F

from loomspark.functions.sqltext import extract_sql
from loomspark.operators import audit, catalog, compare, lineage, reconcile
from loomspark.operators import textjobs as T
from loomspark.sources import files, sinks


def test_labels_are_unique(spark):
    names = ["a:", "a?", "a__2", "Summary", "Summary_2", "x" * 40, "x" * 41, "x" * 29 + "_2"]
    df = spark.createDataFrame([(n,) for n in names], "table_name string")
    out = {r["table_name"]: r["label"] for r in audit.short_unique_labels(df).collect()}
    assert len(set(out.values())) == len(names) and "Summary" not in out.values()
    assert out["a:"] == "a_" and out["a__2"] == "a__2" and out["a?"] not in ("a_", "a__2")
    assert all(len(v) <= 31 for v in out.values())


def test_mapping_keeps_own_dag_names(spark):
    entries = spark.createDataFrame([("m/A.xlsx", ["owndag"], "own.t"), ("m/B.xlsx", ["x"], "own.b")],
                                    "file_path string, dag_names array<string>, bq_table string")
    config = spark.createDataFrame([("A", "cfg.t", []), ("B", "", ["d1"])], "stem string, bq_table string, dag_names array<string>")
    out = {r["file_path"]: (r["bq_table"], r["dag_names"]) for r in lineage.mapping_lookup(entries, config).collect()}
    assert out == {"m/A.xlsx": ("cfg.t", ["owndag"]), "m/B.xlsx": ("own.b", ["d1"])}


def test_trigger_target_in_the_graph_jobs(spark):
    tasks = spark.createDataFrame([
        ("p", "a", "TriggerDagRunOperator", "c1", None, None), ("p", "b", "TriggerDagRunOperator", None, '{"trigger_dag_id": "c2"}', None),
        ("p", "c", "TriggerDagRunOperator", "", None, '{"trigger_dag_id": {"value": "c3"}}'), ("p", "d", "Bash", "no", None, None)],
        "dag_id string, task_id string, operator string, trigger_dag_id string, conf string, params string")
    assert {r["child_dag_id"] for r in lineage.child_dag_edges(tasks).collect()} == {"c1", "c2", "c3"}


def test_lookup_first_equals_brute_force(spark):
    reg = [(i, f"Maps/{a}{b}_map.xlsx", f"t_{a}{i}") for i, (a, b) in enumerate((a, b) for a in "abAx" for b in "yz1")]
    needles = ["MAP", "ay", "x", "zz", "Ax1_map", "t_b", "_map.xlsx", "é", "Maps/a"]
    registry = spark.createDataFrame(reg, "pos long, file_path string, table_name string")
    got = lineage.lookup_first(registry, spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = {n: min((p for p, f, t in reg if n.lower() in f.lower() or n.lower() in t.lower()), default=None) for n in needles}
    assert {r["needle"]: r["pos"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_paths_below_a_repeated_folder_name(spark, tmp_path):
    base = tmp_path / "dags" / "proj" / "dags"
    (base / "x").mkdir(parents=True)
    (base / "x" / "a b.sql").write_text("SELECT 1")
    tree = files.list_tree(spark, str(base)).collect()
    assert [r["rel_path"] for r in tree] == ["x/a b.sql"]
    code = files.scan_code(spark, str(base)).collect()
    assert [r["path"] for r in code] == [r["path"] for r in tree]


def test_store_is_whole_or_empty(spark, tmp_path):
    schema = spark.createDataFrame([], "a int, b string").schema
    assert files.read_store(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "good.json").write_text('{"a": 1}\n{"a": 2, "b": "x"}\n')
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert files.read_store(spark, str(tmp_path / "good.json"), schema).count() == 2
    assert files.read_store(spark, str(tmp_path / "bad.json"), schema).count() == 0


def test_newest_complete_version_only(spark, tmp_path):
    base = str(tmp_path / "store")
    for v in (1, 2, 10):
        sinks.write_version(spark.range(v), base, version=v)
    (tmp_path / "store" / "v=10" / "_SUCCESS").unlink()
    df = sinks.latest_version(spark, base)
    assert df.count() == 2 and all("/v=2/" in f for f in df.inputFiles())


def test_recursive_depth_has_no_limit(spark):
    edges = spark.createDataFrame([("d", f"t{i}", f"t{i + 1}") for i in range(150)], "dag_id string, src string, dst string")
    nodes = spark.createDataFrame([("d", f"t{i}") for i in range(151)], "dag_id string, task_id string")
    out = lineage.task_depth_recursive(edges, nodes)
    assert out.agg(F.max("depth")).first()[0] == 150


def test_row_diff_in_full(spark):
    a = spark.createDataFrame([(1,)] * 5 + [(2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(map(tuple, compare.row_diff(a, b, n=None).collect())) == [
        ("only_in_a", 1, 4), ("only_in_a", 2, 1), ("only_in_b", 3, 1)]


def test_raw_sql_from_files_roots_and_definitions(spark):
    tasks = spark.createDataFrame([("d", "f", '{"sql": " q/a.sql "}'), ("d", "g", '{"configuration": {"query": {"query": "q/none.sql"}}, "x": "SELECT fallback_column FROM t"}'),
                                   ("d", "h", '{"query": "SELECT own_column FROM t"}')], "dag_id string, task_id string, definition string")
    fs = spark.createDataFrame([("q/a.sql", 2, "second"), ("q/a.sql", 1, "first"), ("q/a.sql", 0, "")],
                               "rel_path string, root_order int, content string")
    out = {r["task_id"]: r["raw_sql"] for r in lineage.raw_task_sql(tasks, fs).collect()}
    assert out == {"f": "first", "g": "SELECT fallback_column FROM t", "h": "SELECT own_column FROM t"}


def test_folder_diffs_read_each_side_once_for_bodies(spark, sf):
    from loomspark.sources import standins as S
    git, gcs = S.git_files(spark, sf), S.gcs_files(spark, sf)
    out = reconcile.folder_diffs(git, gcs, reconcile.compare_folders(git, gcs))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and plan.count("Relation [") + plan.count("Relation ") <= 8
    assert out.count() == out.where(F.length("unified_diff") > 0).count()


def test_json_nested_beyond_the_parser_is_not_parseable(spark):
    deep = "[" * 100_000
    rows = spark.createDataFrame([(1, deep), (2, deep + "1" + "]" * 100_000), (3, '{"a": {"sql": "SELECT a, b FROM some_table"}}')],
                                 "id int, doc string")
    out = {r["id"]: (r["sql"], r["js"]) for r in rows.select("id", extract_sql("doc").alias("sql"), T.first_json("doc").alias("js")).collect()}
    assert out[1] == (None, None) and out[2] == (None, None)
    assert out[3] == ("SELECT a, b FROM some_table", '{"a": {"sql": "SELECT a, b FROM some_table"}}')


def test_names_with_percent_signs_and_quotes(spark, tmp_path):
    for name in ("50%off.sql", "a%20b.sql", "a b.sql", "c+d.sql"):
        (tmp_path / name).write_text(f"select '{name}'")
    listed = {r["path"] for r in files.list_objects(spark, str(tmp_path)).collect()}
    assert listed == {f"{tmp_path}/{n}" for n in ("50%off.sql", "a%20b.sql", "a b.sql", "c+d.sql")}
    code = {r["path"]: r["content"] for r in files.scan_code(spark, str(tmp_path)).collect()}
    assert code == {p: f"select '{p.rsplit('/', 1)[1]}'" for p in listed}
    tree = {r["rel_path"] for r in files.list_tree(spark, str(tmp_path)).collect()}
    assert tree == {"50%off.sql", "a%20b.sql", "a b.sql", "c+d.sql"}
    odd = spark.createDataFrame([(1, 2)], "`a``b` int, `x.y` int")
    assert [tuple(r) for r in catalog.stringify_all(odd).collect()] == [("1", "2")]


def test_suffixes_as_written(spark, tmp_path):
    for name in ("a.sql", "b.SQL", "c.Py", "d.py"):
        (tmp_path / name).write_text("x")
    names = lambda **kw: {r["name"] for r in files.scan_code(spark, str(tmp_path), **kw).collect()}
    assert names() == {"a.sql", "b.SQL", "c.Py", "d.py"} and names(any_case=False) == {"a.sql", "d.py"}


def test_audited_write_counts_while_it_writes(spark, tmp_path):
    df = spark.range(1000).repartition(3).where("id % 3 = 0")
    spark.sparkContext.setJobGroup("audited-write", "one run")
    got = sinks.write_audited(df, lambda d: d.write.parquet(f"{tmp_path}/out"), f"{tmp_path}/audit", "m", "src", "q")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("audited-write"))
    spark.sparkContext.setJobGroup("plain-write", "one run")
    df.write.parquet(f"{tmp_path}/again")
    sinks.append_audit(spark.range(1), f"{tmp_path}/other")
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain-write"))
    assert got["row_count"] == 334 == spark.read.parquet(f"{tmp_path}/out").count() and got["duration_ms"] >= 0
    row = spark.read.json(f"{tmp_path}/audit").first()
    assert (row["row_count"], row["module"], row["duration_ms"]) == (334, "m", got["duration_ms"])


def test_nodes_of_repeated_names(spark):
    mapping = spark.createDataFrame([("A", ["d", "d"], "t.old", 1), ("A", ["d"], "t.new", 2), ("A", ["e"], "t.zzz", 0)],
                                    "raw_name string, dag_names array<string>, bq_table string, seq long")
    tasks = spark.createDataFrame([], "dag_id string, task_id string, operator string, sql string, downstream_task_ids array<string>")
    nodes = {r["id"]: r["detail"] for r in lineage.lineage_nodes(mapping, tasks).collect()}
    assert nodes == {"excel:A": "t.new", "dag:d": None, "dag:e": None}
    edges = sorted(map(tuple, lineage.lineage_edges(mapping, tasks).collect()))
    assert edges == [("excel:A", "dag:d", "excel_dag"), ("excel:A", "dag:e", "excel_dag")]
