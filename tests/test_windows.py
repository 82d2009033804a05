"""Windows by halo blocks against Spark's own, on a key that holds most rows."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators.windows import ordered_windows


def skewed(spark, n=3000):
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        ((F.col("id") * 7919) % 997).alias("t"), "id", F.when(F.col("id") % 6 != 0, F.col("id") % 13).alias("v"))


def test_equals_plain_windows(spark):
    df = skewed(spark)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many small blocks
    try:
        got = ordered_windows(df, ["key"], ["t", "id"], number="n", running={"total": "v", "ids": "id"}, shifted={
            "one": ("id", 1), "seven": ("v", 7), "next": ("v", -1), "far": ("id", -150), "long": ("id", 200), "same": ("id", 0)})
        w = Window.partitionBy("key").orderBy("t", "id")
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("*", F.lag("id").over(w), F.lag("v", 7).over(w), F.lead("v").over(w), F.lead("id", 150).over(w),
                         F.lag("id", 200).over(w), F.col("id"), F.sum("v").over(so_far), F.sum("id").over(so_far), F.row_number().over(w))
        assert got.columns == [*df.columns, "one", "seven", "next", "far", "long", "same", "total", "ids", "n"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        blocks = df.repartitionByRange("key", "t", "id").groupBy(F.spark_partition_id().alias("p")).agg(
            F.count_if(F.col("key") == "hot").alias("hot")).where("hot > 0").collect()
        assert len(blocks) > 10 and max(r["hot"] for r in blocks) < 2400 / 4  # no task has the key whole
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_small_blocks_and_empty_tables(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(5)] + [(None, 9, 1)], "key string, t int, v int")
    out = ordered_windows(df, ["key"], ["t"], shifted={"p": ("v", 3), "f": ("v", -2)}, number="n")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [("a", i, i, i - 3 if i >= 3 else None, i + 2 if i < 3 else None, i + 1) for i in range(5)] + [(None, 9, 1, None, None, 1)], key=repr)
    assert ordered_windows(df.limit(0), ["key"], ["t"], running={"s": "v"}).count() == 0
    assert ordered_windows(df, ["key"], ["t"]).count() == 6
