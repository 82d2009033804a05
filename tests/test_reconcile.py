from pyspark.sql import functions as F

from loomspark.operators import reconcile as R


def _inv(spark, rows):
    return spark.createDataFrame(rows, "raw_name string, seq long, content string")


def _map(spark, rows):
    return spark.createDataFrame(rows, "raw_name string, seq long, bq_table string")


def test_statuses(spark):
    git = _inv(spark, [("a.sql", 1, "select 1"), ("b.sql", 1, "x"), ("c.sql", 1, "y"), ("e.sql", 1, None),
                       ("g.sql", 1, "z "), ("dup.sql", 1, "old"), ("dup_v2.sql", 2, "new"), ("h.sql", 1, "")])
    gcs = _inv(spark, [("A.SQL", 1, "  select 1\n"), ("b.sql", 1, "x"), ("d.sql", 1, "q"), ("e.sql", 1, "s"),
                       ("g.sql", 1, "z"), ("dup.sql", 1, "new"), ("h.sql", 1, "")])
    mp = _map(spark, [("a", 1, "p.d.a"), ("c", 1, "p.d.c"), ("d", 1, "p.d.d"), ("f", 1, "p.d.f"),
                      ("e", 1, "p.d.e"), ("g", 1, ""), ("dup", 1, "p.d.dup"), ("h", 1, "p.d.h")])
    acks = spark.createDataFrame([("c",)], "logical_name string")
    out = {r["logical_name"]: r for r in R.reconcile(git, gcs, mp, acks).collect()}
    assert out["a"]["status"] == "in_sync"          # trimmed contents equal
    assert out["b"]["status"] == "undeclared"
    assert out["c"]["status"] == "not_deployed" and out["c"]["acknowledged"] and not out["c"]["critical"]
    assert out["d"]["status"] == "no_source" and out["d"]["critical"]
    assert out["e"]["status"] == "content_drift"    # null content is drift
    assert out["f"]["status"] == "mapping_ghost"
    assert out["g"]["status"] == "bq_missing"       # overrides in_sync
    assert out["dup"]["status"] == "in_sync"        # last duplicate (dup_v2) wins
    assert out["h"]["status"] == "content_drift"    # empty content is drift


def test_summary_partitions_universe(spark, sf):
    from loomspark.sources import standins as S
    f = R.reconcile(S.git_files(spark, sf), S.gcs_files(spark, sf), S.mapping(spark, sf),
                    S.acknowledgements(spark, sf))
    n = f.count()
    assert f.select("logical_name").distinct().count() == n
    summ = R.status_summary(f).collect()
    assert len(summ) == 10 and sum(r["n"] for r in summ) == n
    universe = (S.git_files(spark, sf).select("raw_name").union(S.gcs_files(spark, sf).select("raw_name"))
                .union(S.mapping(spark, sf).select("raw_name")))
    from loomspark.functions.names import normalise_name
    assert universe.select(normalise_name("raw_name")).distinct().count() == n


def test_compare_folders_edges(spark):
    git = spark.createDataFrame([("f/a.sql", 1, "x"), ("f/b.bin", 1, "1"), ("f/c.sql", 1, None),
                                 ("f/sub/d.sql", 1, "d"), ("f/e.sql", 1, "e")], "path string, seq long, content string")
    gcs = spark.createDataFrame([("f/a.sql", 1, "x "), ("f/b.bin", 1, "2"), ("f/c.sql", 1, "c"),
                                 ("f/sub/d.sql", 1, "d"), ("f/z.sql", 1, "z")], "path string, seq long, content string")
    out = {r["rel_path"]: r for r in R.compare_folders(git, gcs, folder="f/").collect()}
    assert out["a.sql"]["status"] == "different"     # exact comparison, no trim
    assert out["b.bin"]["status"] == "identical"     # non-text: not read
    assert out["c.sql"]["status"] == "different" and out["c.sql"]["note"]
    assert out["sub/d.sql"]["status"] == "identical"
    assert out["e.sql"]["status"] == "only_in_git" and out["z.sql"]["status"] == "only_in_gcs"
    one = R.compare_folders(git, gcs, folder="f", file_name="d.sql").collect()
    assert one == []                                 # a file name means a direct child only
    s = R.compare_summary(R.compare_folders(git, gcs, folder="f")).first()
    assert (s["total_git"], s["total_gcs"]) == (5, 5)
    diffs = R.folder_diffs(git, gcs, R.compare_folders(git, gcs, folder="f"), folder="f").collect()
    assert {r["rel_path"] for r in diffs} == {"a.sql"}
    assert "-x" in diffs[0]["unified_diff"] and "+x " in diffs[0]["unified_diff"]


def test_acknowledge_upsert(spark):
    store = spark.createDataFrame([("a", "old", "2024-01-01 00:00:00")], "logical_name string, reason string, t string") \
        .select("logical_name", "reason", F.to_timestamp("t").alias("acknowledged_at"))
    names = spark.createDataFrame([("A_v2.sql",), ("b.sql",)], "raw_name string")
    out = {r["logical_name"]: r["reason"] for r in R.acknowledge(store, names, "new").collect()}
    assert out == {"a": "new", "b": "new"}
