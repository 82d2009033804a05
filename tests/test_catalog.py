"""Catalog metadata of registered tables (Q19)."""
import os

from loomspark.operators import catalog


def test_databases_and_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE meta_one COMMENT 'first' LOCATION '{tmp_path}/one'")
    spark.sql(f"CREATE DATABASE meta_two LOCATION '{tmp_path}/two'")
    try:
        spark.range(10).selectExpr("id", "id % 3 AS part").write.partitionBy("part").saveAsTable("meta_one.parted")
        spark.range(4).write.option("path", f"{tmp_path}/else where/t 1").saveAsTable("meta_one.aside")
        spark.sql("CREATE TABLE meta_two.nothing (a INT, b STRING) USING parquet")
        spark.sql("CREATE VIEW meta_two.seen AS SELECT id FROM meta_one.parted WHERE id < 5")
        spark.range(2).createOrReplaceTempView("meta_temp")
        assert {"meta_one", "meta_two"} <= {r["database"] for r in catalog.databases(spark).collect()}
        rows = {(r["database"], r["table_name"]): r for r in catalog.table_metadata(spark, ["meta_one", "meta_two"]).collect()}
        own = {k: v for k, v in rows.items() if k[0] or k[1] == "meta_temp"}
        assert set(own) == {("meta_one", "parted"), ("meta_one", "aside"), ("meta_two", "nothing"), ("meta_two", "seen"), (None, "meta_temp")}
        for key, place, n, kind in ((("meta_one", "parted"), "one/parted", 10, "MANAGED"),
                                    (("meta_one", "aside"), "else where/t 1", 4, "EXTERNAL")):
            files = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / place) for f in fs if f.endswith(".parquet")]
            r = own[key]
            assert (r["row_count"], r["table_type"], r["provider"]) == (n, kind, "parquet")
            assert (r["files"], r["size_bytes"]) == (len(files), sum(map(os.path.getsize, files)))
            assert abs(r["modified"].timestamp() - max(map(os.path.getmtime, files))) < 2 and r["created"] is not None
        empty, view = own[("meta_two", "nothing")], own[("meta_two", "seen")]
        assert (empty["files"], empty["size_bytes"], empty["row_count"], empty["column_types"]) == (0, 0, 0, "a:int,b:string")
        assert (view["files"], view["size_bytes"], view["row_count"], view["table_type"]) == (None, None, 5, "VIEW")
        assert (own[(None, "meta_temp")]["row_count"], own[(None, "meta_temp")]["table_type"]) == (2, "TEMPORARY")
    finally:
        spark.catalog.dropTempView("meta_temp")
        spark.sql("DROP DATABASE IF EXISTS meta_one CASCADE")
        spark.sql("DROP DATABASE IF EXISTS meta_two CASCADE")
