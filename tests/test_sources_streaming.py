import json
import os
import time
import zipfile

from pyspark.sql import functions as F

from loomspark.sources import files as FI
from loomspark.sources import sinks
from loomspark.sources import workbook as WB


def _col(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, rows):
    """Minimal workbook: shared strings for text, numbers inline."""
    shared, cells_xml = [], []
    for r, row in enumerate(rows, 1):
        cs = []
        for c, v in enumerate(row):
            if v is None:
                continue
            ref = f"{_col(c)}{r}"
            if isinstance(v, str):
                if v not in shared:
                    shared.append(v)
                cs.append(f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>')
            else:
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells_xml.append(f'<row r="{r}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(cells_xml)}</sheetData></worksheet>')


def test_workbook_ingest(spark, tmp_path):
    m = tmp_path / "mapping" / "teamA"
    s = tmp_path / "master"
    m.mkdir(parents=True)
    s.mkdir(parents=True)
    write_xlsx(m / "Orders Map.xlsx", [["meta"], ["meta2"], [None], ["col", "col", None, "n"],
                                       ["a", "b", "c", 1], ["d", None, None, 2.5]])
    write_xlsx(s / "Ref.xlsx", [["k", "v"], ["x", 1]])
    (s / "broken.xlsx").write_bytes(b"not a zip")
    files = WB.workbook_files(spark, {"mapping": str(tmp_path / "mapping"), "master": str(s)})
    cells, entries = WB.ingest(files)
    ent = {os.path.basename(r["file_path"]): r for r in entries.collect()}
    assert ent["Orders Map.xlsx"]["table_name"] == "teama_orders_map"
    assert ent["Orders Map.xlsx"]["columns"] == ["col", "col.1", "Unnamed: 2", "n"]
    assert ent["Orders Map.xlsx"]["row_count"] == 2
    assert ent["Ref.xlsx"]["table_name"] == "master_ref" and ent["Ref.xlsx"]["row_count"] == 1
    assert ent["broken.xlsx"]["status"] == "error"
    t = WB.workbook_table(cells, [r["file_path"] for r in entries.collect() if r["file_path"].endswith("Map.xlsx")][0])
    assert [tuple(r) for r in t.collect()] == [("a", "b", "c", "1"), ("d", None, None, "2.5")]
    # unchanged files are skipped on the next run
    _, again = WB.ingest(files, registry=entries)
    assert again.count() == 0


def test_listing_code_logs_and_config(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "a.sql").write_text("select 1")
    (tmp_path / "sql" / "B.PY").write_text("from airflow import DAG\n")
    (tmp_path / "sql" / "c.txt").write_text("x")
    lst = FI.list_objects(spark, str(tmp_path), with_md5=True)
    assert lst.count() == 3 and lst.where("name = 'a.sql'").first()["size"] == 8
    code = {r["name"] for r in FI.scan_code(spark, str(tmp_path)).collect()}
    assert code == {"a.sql", "B.PY"}
    (tmp_path / "log.txt").write_text("l1\nERROR x\nl3")
    lines = FI.read_log_lines(spark, str(tmp_path / "log.txt")).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in lines] == [(1, "l1"), (2, "ERROR x"), (3, "l3")]
    cfg = tmp_path / "map.json"
    cfg.write_text(json.dumps({"Sheet A": {"bq_table": "p.d.t", "dag_names": ["d1", "d2"]},
                               "b": {"bq_table": "", "dag_names": []}}))
    c = FI.read_mapping_config(spark, str(cfg))
    assert {r["stem"]: r["bq_table"] for r in c.collect()} == {"Sheet A": "p.d.t", "b": ""}
    assert FI.mapping_dags(c).count() == 3


def test_run_payloads(spark, tmp_path):
    p = tmp_path / "runs.json"
    p.write_text(json.dumps({"dag_runs": [
        {"dag_id": "d", "dag_run_id": "r1", "execution_date": "2024-01-01T00:00:00Z",
         "start_date": "2024-01-01T00:00:05Z", "end_date": "2024-01-01T00:01:05Z", "state": "success"},
        {"dag_id": "d", "dag_run_id": "r2", "logical_date": "2024-01-02T00:00:00+00:00", "start_date": None,
         "state": "running"}]}))
    r = {x["run_id"]: x for x in FI.read_runs(spark, str(p)).collect()}
    assert r["r1"]["logical_date"] is not None and r["r1"]["start_date"] is not None
    assert r["r2"]["start_date"] is None


def test_sinks_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"))], "k int, v double")
    sinks.write_json(df, str(tmp_path / "j"))
    txt = "".join(open(os.path.join(tmp_path / "j", f)).read() for f in os.listdir(tmp_path / "j") if f.endswith(".json"))
    assert "NaN" not in txt
    base = str(tmp_path / "store")
    sinks.write_version(spark.createDataFrame([(1,)], "k int"), base, 1)
    sinks.write_version(spark.createDataFrame([(2,)], "k int"), base, 2)
    assert [r["k"] for r in sinks.latest_version(spark, base).collect()] == [2]
    assert sinks.latest_version(spark, str(tmp_path / "none")) is None


def test_health_stream_watermark(spark, tmp_path):
    from loomspark.streaming.health import health_windows
    src = tmp_path / "ti"
    schema = "dag_id string, task_id string, state string, duration_s double, start_date timestamp"

    def land(rows, name):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(src))

    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    land([("d", "t", "success", 10.0, t0), ("d", "t", "failed", 20.0, t0 + dt.timedelta(minutes=5))], "a")
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = (health_windows(stream, "10 minutes", watermark="1 minute").writeStream.outputMode("append")
         .format("memory").queryName("hw").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    land([("d", "t", "success", 30.0, t0 + dt.timedelta(minutes=30))], "b")   # advances the watermark
    q.processAllAvailable()
    land([("d", "t", "success", 99.0, t0 + dt.timedelta(minutes=1))], "c")   # late: dropped
    q.processAllAvailable()
    land([("d", "t", "success", 1.0, t0 + dt.timedelta(minutes=50))], "d")
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM hw ORDER BY window_start").collect()
    first = out[0]
    assert first["instances"] == 2 and first["avg_duration_s"] == 15.0 and first["success_rate"] == 0.5


def test_snapshot_diff(spark, tmp_path):
    from loomspark.operators.snapshots import snapshot_diff
    base = str(tmp_path / "snap")
    v1 = spark.createDataFrame([("a.py", "x\n"), ("b.py", "y\n")], "path string, content string")
    first = snapshot_diff(spark, v1, base, version=1).collect()
    assert {r["status"] for r in first} == {"baseline"} and not any(r["has_changes"] for r in first)
    v2 = spark.createDataFrame([("a.py", "x\nz\n"), ("c.py", "new\n")], "path string, content string")
    out = {r["path"]: r for r in snapshot_diff(spark, v2, base, version=2).collect()}
    assert out["a.py"]["status"] == "changed" and "+z" in out["a.py"]["unified_diff"]
    assert out["b.py"]["status"] == "removed" and out["c.py"]["status"] == "added"
    again = snapshot_diff(spark, v2, base, version=3).collect()
    assert not any(r["has_changes"] for r in again)


def test_catalog_and_audit(spark, tmp_path):
    from loomspark.operators import catalog, stores
    spark.createDataFrame([(1,), (2,)], "k int").createOrReplaceTempView("t_small")
    cat = {r["table_name"]: r for r in catalog.catalog_tables(spark).collect()}
    assert cat["t_small"]["row_count"] == 2
    rec = stores.audit_record(spark.table("t_small"), "m", "src", "q", duration_ms=5)
    sinks.append_audit(rec, str(tmp_path / "audit"))
    sinks.append_audit(rec, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_workbook_stream_ingest(spark, tmp_path):
    from loomspark.streaming.ingest import start_workbook_stream
    root = tmp_path / "mapping"
    (root / "team").mkdir(parents=True)
    write_xlsx(root / "team" / "One.xlsx", [["m"], ["m"], ["m"], ["a", "b"], ["1", "2"]])
    q = start_workbook_stream(spark, str(root), "mapping", str(tmp_path / "registry"), str(tmp_path / "audit"),
                              str(tmp_path / "ck"), str(tmp_path / "cells"))
    q.processAllAvailable()
    write_xlsx(root / "team" / "Two.xlsx", [["m"], ["m"], ["m"], ["x"], ["9"], ["8"]])
    q.processAllAvailable()
    q.stop()
    reg = {os.path.basename(r["file_path"]): r for r in sinks.latest_version(spark, str(tmp_path / "registry")).collect()}
    assert set(reg) == {"One.xlsx", "Two.xlsx"} and reg["Two.xlsx"]["row_count"] == 2
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    # the last batch is replayed after a crash before its commit: same state
    from loomspark.streaming.ingest import current_cells
    cells = sorted(map(tuple, current_cells(spark, str(tmp_path / "registry"), str(tmp_path / "cells")).collect()), key=repr)
    os.remove(tmp_path / "ck" / "commits" / "1")
    if (tmp_path / "ck" / "commits" / ".1.crc").exists():
        os.remove(tmp_path / "ck" / "commits" / ".1.crc")
    q = start_workbook_stream(spark, str(root), "mapping", str(tmp_path / "registry"), str(tmp_path / "audit"),
                              str(tmp_path / "ck"), str(tmp_path / "cells"))
    q.processAllAvailable()
    assert sorted(map(tuple, current_cells(spark, str(tmp_path / "registry"), str(tmp_path / "cells")).collect()), key=repr) == cells
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    write_xlsx(root / "team" / "Three.xlsx", [["m"], ["m"], ["m"], ["id", "name", "note"]])
    q.processAllAvailable()
    q.stop()
    reg = {os.path.basename(r["file_path"]): r for r in sinks.latest_version(spark, str(tmp_path / "registry")).collect()}
    assert set(reg) == {"One.xlsx", "Two.xlsx", "Three.xlsx"}
    assert reg["Three.xlsx"]["row_count"] == 0 and reg["Three.xlsx"]["columns"] == ["id", "name", "note"]
    assert current_cells(spark, str(tmp_path / "registry"), str(tmp_path / "cells")).where("row_no > 0").count() == 4


def test_writers(spark, tmp_path):
    from loomspark.operators import audit as A
    from loomspark.operators import stores
    meta = spark.createDataFrame([("t1", "a", 2, "int", 1), ("t1", "b", 1, "varchar", 1)],
                                 "table_name string, column_name string, ordinal_position long, data_type string, "
                                 "deployed_to_prod int")
    target = spark.createDataFrame([("t1", "a", 1, "STRING", "")],
                                   "table_name string, column_name string, ordinal_position long, data_type string, "
                                   "description string")
    sinks.write_audit(A.schema_audit(meta, target), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit" / "summary")).count() == 2
    sinks.write_ddl(A.schema_ddl_rows(meta), str(tmp_path / "ddl"))
    ddl = spark.read.json(str(tmp_path / "ddl")).orderBy("position").collect()
    assert [(r["name"], r["type"], r["mode"]) for r in ddl] == [("b", "STRING", "NULLABLE"), ("a", "INT64", "NULLABLE")]
    files = spark.createDataFrame([("sql", "ok", "select 1"), ("py", "error", "x")],
                                  "file_type string, status string, content string")
    sinks.write_text_bundle(files, str(tmp_path / "bundle"))
    assert spark.read.text(str(tmp_path / "bundle")).count() == 1
    store = spark.createDataFrame([("1", "q")], "id string, name string").withColumn("created_at", F.current_timestamp())
    added = stores.append(store, spark.createDataFrame([("r",)], "name string")).collect()
    assert len(added) == 2 and all(r["id"] for r in added)


def test_log_lines_split_across_tasks(spark, tmp_path):
    """A log larger than the split size is read by several tasks; numbering stays exact."""
    big = tmp_path / "big.log"
    lines = [f"line {i} " + ("x" * (i % 50)) + (" ERROR" if i % 97 == 0 else "") for i in range(40000)]
    big.write_text("\n".join(lines) + "\n")
    (tmp_path / "small.log").write_text("a\r\nb\n\nc")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
        got = FI.read_log_lines(spark, str(tmp_path))
        rows = {(os.path.basename(r["path"]), r["line_no"]): r["line"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(1 for k in rows if k[0] == "big.log") == 40000
    assert all(rows[("big.log", i + 1)] == lines[i] for i in range(40000))
    assert [rows[("small.log", i)] for i in (1, 2, 3, 4)] == ["a", "b", "", "c"]


def test_landed_payloads_feed_the_operators(spark, tmp_path):
    from loomspark.operators import runs as R
    (tmp_path / "runs.json").write_text(json.dumps({"dag_runs": [
        {"dag_id": "d", "dag_run_id": f"r{i}", "execution_date": f"2024-01-0{i}T00:00:00Z",
         "start_date": f"2024-01-0{i}T00:00:00Z", "end_date": f"2024-01-0{i}T00:00:30Z", "state": "success"}
        for i in range(1, 6)]}))
    (tmp_path / "ti.json").write_text(json.dumps({"task_instances": [
        {"dag_id": "d", "dag_run_id": "r1", "task_id": "t", "state": s, "duration": d,
         "start_date": "2024-01-01T00:00:00Z", "end_date": "2024-01-01T00:00:10Z", "try_number": 1}
        for s, d in [("success", 10.0), ("failed", 20.0), ("success", None)]]}))
    hist = R.run_history(FI.read_runs(spark, str(tmp_path / "runs.json")), n=3).collect()
    assert len(hist) == 3 and all(h["duration_s"] == 30.0 for h in hist)
    perf = R.task_performance(FI.read_task_instances(spark, str(tmp_path / "ti.json"))).first()
    assert (perf["run_count"], perf["avg_duration_s"], perf["p95_duration_s"], perf["success_rate"]) == (2, 15.0, 20.0, 0.667)


def test_task_payload_feeds_the_graph(spark, tmp_path):
    from loomspark.operators import lineage as L
    (tmp_path / "dag_x.json").write_text(json.dumps({"tasks": [
        {"task_id": "a", "class_ref": {"class_name": "EmptyOperator"}, "downstream_task_ids": ["b"]},
        {"task_id": "b", "class_ref": {"class_name": "BigQueryInsertJobOperator"}, "downstream_task_ids": [],
         "sql": "SELECT 1 FROM t WHERE x = 1"}]}))
    tasks = FI.read_tasks(spark, str(tmp_path / "dag_x.json"))
    assert [(r["dag_id"], r["task_id"]) for r in L.root_tasks(tasks).collect()] == [("dag_x", "a")]
    assert L.sql_coverage(tasks).first()["tasks_with_sql"] == 1
