"""Joins of the SQL and depth jobs that must not move more than they need."""
from pyspark.sql import functions as F

from loomspark.operators import lineage
from loomspark.sources import standins as S


def test_levels_are_not_broadcast(spark, monkeypatch):
    plans = []
    cut = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.sql("SELECT * FROM VALUES ('g', 'a', 'b'), ('g', 'b', 'c'), ('g', 'c', 'a'), ('g', 'r', 'a') AS e(dag_id, src, dst)")
    nodes = spark.sql("SELECT * FROM VALUES ('g', 'a'), ('g', 'b'), ('g', 'c'), ('g', 'r') AS n(dag_id, task_id)")
    got = {r["task_id"]: r["depth"] for r in lineage.task_depth(edges, nodes).collect()}
    assert got == {"r": 0, "a": 1, "b": 2, "c": 3}
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]


def test_tasks_without_a_file_are_spread(spark):
    tasks = spark.range(400).select(
        F.lit("d").alias("dag_id"), F.concat(F.lit("t"), F.col("id")).alias("task_id"),
        F.when(F.col("id") < 10, F.concat(F.lit('{"sql": "sql/f'), F.col("id"), F.lit('.sql"}'))).otherwise(
            F.lit('{"sql": "SELECT a, b, c FROM ds.table_1"}')).alias("definition"))
    files = spark.range(5).select(F.concat(F.lit("sql/f"), F.col("id"), F.lit(".sql")).alias("rel_path"), F.lit("SELECT 1").alias("content"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = lineage.raw_task_sql(tasks, files).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    parts = [r["part"] for r in out]
    assert len(out) == 400 and max(map(parts.count, set(parts))) < 200
    assert sorted(r["task_id"] for r in out if r["raw_sql"] == "SELECT 1") == [f"t{i}" for i in range(5)]
    assert sum(r["raw_sql"] is None for r in out) == 5


def test_runs_are_read_once_for_instances(spark, sf):
    df = lineage.latest_task_sql(S.dag_runs(spark, sf), S.rendered_instances(spark, sf), 10)
    assert df._jdf.queryExecution().executedPlan().toString().count("orders.parquet") == 1
