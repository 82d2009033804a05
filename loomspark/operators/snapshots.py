"""Q8/K7: compare a folder of sources with its previous snapshot.

Snapshots are versioned Parquet folders (base/v=<n>).  The first run stores a baseline
and reports no change; later runs compare content hashes, diff only the changed files
and then write the next version — the version being read is never overwritten.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import sinks
from .reconcile import diff_pairs


def snapshot_diff(spark: SparkSession, current: DataFrame, base: str, version: int | None = None,
                  key: str = "path", content: str = "content") -> DataFrame:
    """Per file: added / removed / changed / unchanged (plus a unified diff for changed);
    on the first run a single 'baseline' row per file with has_changes = false."""
    cur = current.select(key, content)
    prev = sinks.latest_version(spark, base)
    if prev is None:
        sinks.write_version(cur, base, version)
        written = sinks.latest_version(spark, base)
        return written.select(key, F.lit("baseline").alias("status"), F.lit(False).alias("has_changes"),
                              F.lit(None).cast("string").alias("unified_diff"))
    u = (cur.select(key, F.lit("cur").alias("src"), F.sha2(content, 256).alias("h"))
         .unionByName(prev.select(key, F.lit("prev").alias("src"), F.sha2(content, 256).alias("h"))))
    g = u.groupBy(key).agg(F.max(F.when(F.col("src") == "cur", F.col("h"))).alias("hc"),
                           F.max(F.when(F.col("src") == "prev", F.col("h"))).alias("hp"),
                           F.max(F.col("src") == "cur").alias("in_cur"), F.max(F.col("src") == "prev").alias("in_prev"))
    status = (F.when(~F.col("in_prev"), "added").when(~F.col("in_cur"), "removed")
              .when(F.col("hc") == F.col("hp"), "unchanged").otherwise("changed"))
    st = g.select(key, status.alias("status"))
    changed = st.where(F.col("status") == "changed").select(key)
    diffs = diff_pairs(changed, prev.select(key, content), cur, key, content)
    out = (st.join(diffs, key, "left").select(key, "status", (F.col("status") != "unchanged").alias("has_changes"),
                                               "unified_diff"))
    # materialise the comparison before the new version is written, so the result does
    # not depend on which version is "latest" when it is read
    out = cut_lineage(out)
    sinks.write_version(cur, base, version)
    return out
