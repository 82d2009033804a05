"""Result-set comparison.

The reference sorts both results and compares them position by position; that needs a
global sort and a single ordered stream.  Here equality is multiset equality: one
aggregate over the tagged union of both sides counts every distinct row per side
(map-side combined).  That gives the same verdict as "sorted rows are equal", and the
rows whose counts differ are exactly ``exceptAll`` in both directions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _canonical(c: Column, t: DataType) -> Column:
    """A value of the same meaning that can be grouped and ordered: map entries in the order of their keys,
    variants as JSON."""
    if t.typeName() == "variant":
        return F.to_json(c)
    if isinstance(t, MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            e["key"].alias("key"), _canonical(e["value"], t.valueType).alias("value")))
        return F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    if isinstance(t, StructType) and _needs(t):
        made = F.struct(*[_canonical(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(t.fields)])
        return F.when(c.isNotNull(), made)
    if isinstance(t, ArrayType) and _needs(t):
        return F.transform(c, lambda x: _canonical(x, t.elementType))
    return c


def _needs(t: DataType) -> bool:
    """Whether a type holds a map or a variant, which cannot take part in set operations."""
    if isinstance(t, MapType) or t.typeName() == "variant":
        return True
    if isinstance(t, StructType):
        return any(_needs(f.dataType) for f in t.fields)
    return isinstance(t, ArrayType) and _needs(t.elementType)


def _comparable(df: DataFrame) -> DataFrame:
    """The columns by position, c0, c1, ... (names may repeat), in a form that set operations take: values with a
    map or variant inside as JSON of their canonical form."""
    src = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return src.select([F.to_json(_canonical(F.col(f.name), f.dataType)).alias(f.name)
                       if _needs(f.dataType) and f.dataType.typeName() != "variant"
                       else _canonical(F.col(f.name), f.dataType).alias(f.name) for f in src.schema.fields])


def _delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per distinct row: how often it occurs in ``a`` and in ``b`` (one shuffle on all
    columns, partial counts combined map-side)."""
    a, b = _comparable(a), _comparable(b)
    cols = a.columns
    u = (a.select(*cols, F.lit(1).alias("_s"))
         .unionByName(b.select(*cols, F.lit(-1).alias("_s"))))
    return u.groupBy(*cols).agg(F.count_if(F.col("_s") == 1).alias("_ca"),
                                F.count_if(F.col("_s") == -1).alias("_cb"))


def row_diff(a: DataFrame, b: DataFrame, n: int | None = 100) -> DataFrame:
    """Rows of ``a`` missing from ``b`` and vice versa, counted with multiplicity
    (``exceptAll`` both ways), tagged by side; the first ``n`` in (side, all columns) order.
    ``n=None``: all of them, each distinct row once with ``times``, the copies it has too many.
    Columns are matched by position and may repeat a name; maps are equal whatever the order of their
    entries, and come out as JSON of their entries by key."""
    cols = [f"c{i}" for i in range(len(a.columns))]
    d = _delta(a, b).where(F.col("_ca") != F.col("_cb"))
    side = F.when(F.col("_ca") > F.col("_cb"), F.lit("only_in_a")).otherwise(F.lit("only_in_b"))
    times = F.abs(F.col("_ca") - F.col("_cb"))
    if n is None:
        return d.select(side.alias("side"), *cols, times.alias("times")).toDF("side", *a.columns, "times")
    times = F.least(times, F.lit(n)).cast("int")  # never more than n copies are reported
    d = d.select(side.alias("_side"), *cols, F.explode(F.array_repeat(F.lit(0), times)).alias("_x")).drop("_x")
    return d.orderBy("_side", *cols).limit(n).toDF("side", *a.columns)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint: row count and the exact (decimal) sum of 64-bit row
    hashes. One pass, no sort; duplicates change it."""
    d = _comparable(df)
    h = F.xxhash64(*[F.col(c) for c in d.columns]).cast("decimal(38,0)")
    return d.agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).cast("string").alias("hash_sum"))


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: PASS iff row counts equal, column names and order equal and the data equal
    (as multisets).  Data are compared only when the columns match."""
    cols_match = a.columns == b.columns
    if cols_match:
        d = _delta(a, b)
        out = d.agg(F.sum("_ca").alias("row_count_a"), F.sum("_cb").alias("row_count_b"),
                    F.sum(F.greatest(F.col("_ca") - F.col("_cb"), F.lit(0))).alias("only_in_a"),
                    F.sum(F.greatest(F.col("_cb") - F.col("_ca"), F.lit(0))).alias("only_in_b"))
    else:
        u = a.select(F.lit(1).alias("_s")).unionByName(b.select(F.lit(-1).alias("_s")))
        out = u.agg(F.count_if(F.col("_s") == 1).alias("row_count_a"),
                    F.count_if(F.col("_s") == -1).alias("row_count_b"),
                    F.lit(None).cast("long").alias("only_in_a"), F.lit(None).cast("long").alias("only_in_b"))
    rc_a = F.coalesce(F.col("row_count_a"), F.lit(0))
    rc_b = F.coalesce(F.col("row_count_b"), F.lit(0))
    data_match = F.coalesce((F.col("only_in_a") == 0) & (F.col("only_in_b") == 0), F.lit(False))
    status = F.when(F.lit(cols_match) & (rc_a == rc_b) & data_match, F.lit("PASS")).otherwise(F.lit("FAIL"))
    return out.select(
        status.alias("status"),
        rc_a.cast("long").alias("row_count_a"),
        rc_b.cast("long").alias("row_count_b"),
        F.lit(cols_match).alias("columns_match"),
        F.lit(",".join(a.columns)).alias("columns_a"),
        F.lit(",".join(b.columns)).alias("columns_b"),
        data_match.alias("data_match"),
        F.col("only_in_a").cast("long").alias("only_in_a"),
        F.col("only_in_b").cast("long").alias("only_in_b"))


def verdict(comparison: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """SAFE iff the comparison passed and no check row has result 'fail'.
    Adds the mechanical check ``output_columns_unchanged``."""
    c = comparison.select("status", "columns_match")
    rows = [c.select(F.lit("output_columns_unchanged").alias("check"),
                     F.when(F.col("columns_match"), "pass").otherwise("fail").alias("result")),
            c.select(F.lit(None).cast("string").alias("check"), F.col("status").alias("result"))]
    if checks is not None:
        rows.append(checks.select("check", "result"))
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    agg = u.agg(F.count_if(F.col("check").isNotNull() & (F.col("result") == "fail")).alias("failed_checks"),
                F.max(F.when(F.col("check").isNull(), F.col("result"))).alias("comparison_status"))
    return agg.select(
        F.when((F.col("comparison_status") == "PASS") & (F.col("failed_checks") == 0), "SAFE")
        .otherwise("UNSAFE").alias("verdict"),
        "comparison_status", F.col("failed_checks").cast("long").alias("failed_checks"))
