"""Exact order statistics per group that stay balanced when one group is huge.

A window ``partitionBy(group).orderBy(value)`` sends a whole group to one task.
Here the rows are first collapsed to (group, value, multiplicity) with a map-side
combined aggregate, then range-partitioned on (group, value) so that a hot group is
spread over many partitions.  A tiny table of per-(partition, group) totals gives
every block its offset, and only the one block holding rank k is ranked locally.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def kth_smallest(rows: DataFrame, keys: Sequence[str], value: str, k: DataFrame,
                 k_col: str = "_k", out: str | None = None) -> DataFrame:
    """For every group in ``k`` (keys + 1-based rank ``k_col``) return the value of rank k
    among the non-null ``value`` of ``rows`` in that group (duplicates counted)."""
    keys = list(keys)
    out = out or value
    dist = (rows.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m")))
    # one materialisation fixes the partition ids (range bounds are sampled, so two
    # evaluations of the exchange could place rows differently).  Without an explicit
    # count AQE may merge adjacent ranges, which keeps every partition a contiguous slice.
    ranged = cut_lineage(dist.repartitionByRange(*[F.col(c) for c in keys], F.col(value))
                         .withColumn("_pid", F.spark_partition_id()))
    blocks = ranged.groupBy("_pid", *keys).agg(F.sum("_m").alias("_bm"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_bm").over(before), F.lit(0)))
    target = (blocks.join(k.select(*keys, F.col(k_col).alias("_k")), keys)
              .where((F.col("_k") > F.col("_off")) & (F.col("_k") <= F.col("_off") + F.col("_bm")))
              .select("_pid", *keys, (F.col("_k") - F.col("_off")).alias("_lk")))
    cand = ranged.join(target, ["_pid", *keys])
    upto = Window.partitionBy("_pid", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("_cum", F.sum("_m").over(upto))
    hit = (F.col("_cum") >= F.col("_lk")) & (F.col("_cum") - F.col("_m") < F.col("_lk"))
    return cand.where(hit).select(*keys, F.col(value).alias(out))


def row_number_balanced(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_number") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without sending a whole
    group to one task: rows are range-partitioned on (keys, order) (materialised once),
    numbered inside each (partition, key) block, and shifted by the number of rows of the
    same key in earlier partitions.  ``order`` should make rows unique within a key."""
    keys, order = list(keys), list(order)
    ranged = cut_lineage(df.repartitionByRange(*[F.col(c) for c in keys + order])
                         .withColumn("_pid", F.spark_partition_id()))
    blocks = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0))).drop("_bn")
    local = Window.partitionBy("_pid", *keys).orderBy(*order)
    return (ranged.withColumn("__local_rn", F.row_number().over(local)).join(offsets, ["_pid", *keys])
            .withColumn(out, (F.col("__local_rn") + F.col("_off")).cast("long"))
            .drop("_pid", "__local_rn", "_off"))
