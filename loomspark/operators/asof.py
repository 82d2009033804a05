"""As-of join that stays balanced when one key holds a large share of the rows.

For every left row (key, time) it finds the right row with the same key and the
greatest (time, order) not after the left time.  A plain window
``partitionBy(key).orderBy(time)`` over the union of both sides puts a whole key in one
task; here the union is range-partitioned on (key, time), so a hot key is spread over
many partitions in time order:

1. inside each (partition, key) block, the last right row seen so far is carried
   forward with a running ``last(..., ignorenulls)`` window — a block is at most one
   partition's worth of rows;
2. a tiny table with one row per (partition, key) block gives, for each block, the last
   right row of all *earlier* blocks of the same key (the carry-in);
3. the answer is the block-local match, else the carry-in.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              right_cols: Sequence[str], right_order: str | None = None,
              left_id: Sequence[str] = ()) -> DataFrame:
    """left ⟕ (latest right row with right.key = left.key and right_time <= left_time).

    Ties on time are broken by ``right_order`` (largest wins).  Returns all left columns
    plus ``right_cols`` (null when there is no earlier right row)."""
    right_cols = list(right_cols)
    order = right_order or right_time
    lcols = left.columns
    payload = F.struct(*[F.col(c) for c in right_cols])
    l_ = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_kind"),
                     F.lit(None).cast(right.select(F.col(order)).schema[0].dataType).alias("_o"),
                     F.struct(*[F.col(c) for c in lcols]).alias("_left"),
                     F.lit(None).cast(right.select(payload.alias("p")).schema[0].dataType).alias("_right"))
    r_ = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_kind"),
                      F.col(order).alias("_o"),
                      F.lit(None).cast(left.select(F.struct(*[F.col(c) for c in lcols]).alias("s")).schema[0].dataType)
                      .alias("_left"),
                      payload.alias("_right"))
    # right rows sort before left rows at equal time (<=), larger order last among equals
    # partition ids come from one materialisation: range bounds are sampled, so separate
    # evaluations of the exchange could assign rows differently
    u = cut_lineage(l_.unionByName(r_).repartitionByRange("_k", "_t", "_kind", "_o")
                    .withColumn("_pid", F.spark_partition_id()))
    seq = ["_t", "_kind", "_o"]
    upto = Window.partitionBy("_pid", "_k").orderBy(*seq).rowsBetween(Window.unboundedPreceding, 0)
    local = u.withColumn("_m", F.last("_right", ignorenulls=True).over(upto))
    blocks = (u.where(F.col("_kind") == 0).groupBy("_pid", "_k")
              .agg(F.max_by("_right", F.struct(*seq)).alias("_last")))
    before = Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # blocks of a key that hold only left rows still need their carry-in
    left_blocks = u.where(F.col("_kind") == 1).select("_pid", "_k").distinct()
    all_blocks = left_blocks.join(blocks.select("_pid", "_k"), ["_pid", "_k"], "left_anti").select("_pid", "_k") \
        .withColumn("_last", F.lit(None).cast(blocks.schema["_last"].dataType)) \
        .unionByName(blocks)
    carry = (all_blocks.withColumn("_in", F.last("_last", ignorenulls=True).over(before))
             .select("_pid", "_k", "_in"))
    out = (local.where(F.col("_kind") == 1).join(carry, ["_pid", "_k"], "left")
           .select("_left.*", F.coalesce("_m", "_in").alias("_r")))
    return out.select(*lcols, *[F.col("_r")[c].alias(c) for c in right_cols])
