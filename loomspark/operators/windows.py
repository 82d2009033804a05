"""Ordered windows that stay balanced when one key holds a large share of the rows.

``partitionBy(key).orderBy(time)`` puts a whole key in one task.  Here the rows are range-partitioned on
(key, order), so a hot key is spread over many blocks in its order, and what a row needs from other
blocks travels in a table with one row for each block of a key:

- its totals, of which the sum over earlier blocks is added to running counts and sums,
- its first and last rows, as many as the widest ``lag`` or ``lead``, which are a block's halo: the rows
  just before it are the last ones of the blocks before it, at most as many blocks as rows.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def ordered_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], shifted: Mapping[str, tuple[str, int]] = {},
                    running: Mapping[str, str] = {}, number: str | None = None) -> DataFrame:
    """All columns of ``df`` and, for each row among those of its ``keys`` in ascending ``order``:

    ``shifted``: name → (column, n), the column's value n rows before (n > 0) or after (n < 0), null where there is
    none; ``running``: name → column, the sum of the column up to and with the row (null where there is no value yet);
    ``number``: the name of the row's number from 1.  Rows that tie on ``order`` count in no stated order.  Null keys
    are one key, nulls in the order come first."""
    back = max((n for _, n in shifted.values()), default=0)
    ahead = -min((n for _, n in shifted.values()), default=0)
    at = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    u = cut_lineage(df.select("*", *at).repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))
    block = Window.partitionBy("_block", *names)
    local = block.orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    needed = sorted({c for c, _ in shifted.values()})
    row = F.struct("_n", *[F.col(c).alias(f"_v{i}") for i, c in enumerate(needed)])
    u = u.withColumn("_n", F.row_number().over(local)).withColumn("_left", F.count(F.lit(1)).over(block) - F.col("_n"))
    for name, c in running.items():
        u = u.withColumn(name, F.sum(c).over(upto))
    for name, (c, n) in shifted.items():
        u = u.withColumn(f"_in_{name}", F.lag(c, n).over(local) if n >= 0 else F.lead(c, -n).over(local))

    edge = lambda test: F.array_sort(F.collect_list(F.when(test, row)))
    blocks = u.groupBy("_block", *names).agg(
        F.count(F.lit(1)).alias("_rows"), edge(F.col("_left") < back).alias("_last"), edge(F.col("_n") <= ahead).alias("_first"),
        *[F.sum(c).alias(f"_sum_{name}") for name, c in running.items()])
    by_block = Window.partitionBy(*names).orderBy("_block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    before, after = by_block.rowsBetween(-max(back, 1), -1), by_block.rowsBetween(1, max(ahead, 1))
    rows_of = lambda c, frame: F.flatten(F.collect_list(c).over(frame))
    halo = blocks.select(
        F.col("_block").alias("_b"), *[F.col(c).alias(f"_h{c}") for c in names], F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_past"),
        *([rows_of("_last", before).alias("_before")] if back else []), *([rows_of("_first", after).alias("_after")] if ahead else []),
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_past_{name}") for name in running])
    on = u["_block"] == halo["_b"]
    for c in names:
        on = on & u[c].eqNullSafe(halo[f"_h{c}"])
    out = u.join(halo, on)
    for name in running:
        total: Column = F.coalesce(F.col(name) + F.col(f"_past_{name}"), F.col(name), F.col(f"_past_{name}"))
        out = out.withColumn(name, total)
    for name, (c, n) in shifted.items():
        field = f"_v{needed.index(c)}"
        if n >= 0:  # so many rows of the halo back
            k = (F.lit(n) - F.col("_n") + 1).cast("int")
            far = F.when(k > 0, F.try_element_at("_before", -k)[field]) if n else F.lit(None)
            inside = F.col("_n") > n
        else:
            k = (F.lit(-n) - F.col("_left")).cast("int")
            far = F.when(k > 0, F.try_element_at("_after", k)[field])
            inside = F.col("_left") >= -n
        out = out.withColumn(name, F.when(inside, F.col(f"_in_{name}")).otherwise(far))
    if number:
        out = out.withColumn(number, (F.col("_past") + F.col("_n")).cast("long"))
    return out.select(*df.columns, *shifted, *running, *([number] if number else []))
