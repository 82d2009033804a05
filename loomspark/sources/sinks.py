"""Writers (K1–K8).  Every writer is a distributed ``DataFrameWriter`` call; nothing is
collected.  Stores are written as new versions, never over the path being read."""
from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.textjobs import json_safe


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: CSV with a header row."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: JSON lines; NaN / ±Infinity written as null."""
    json_safe(df).write.mode(mode).json(path)


def write_audit(audit: DataFrame, path: str) -> None:
    """K3: findings summary (non-matching rows) plus the full audit laid out per table."""
    from ..operators.audit import audit_findings
    audit_findings(audit).write.mode("overwrite").parquet(f"{path}/summary")
    audit.write.mode("overwrite").partitionBy("batch", "table_name").parquet(f"{path}/tables")


def write_ddl(ddl_rows: DataFrame, path: str) -> None:
    """K4: target DDL as JSON lines per (batch, table), fields in position order.  Each
    line is one field {position, name, type, mode}; the table is the folder.  Range
    partitioning on (batch, table, position) keeps file order = field order and splits a
    very wide table over several tasks instead of assembling it in one."""
    n = int(ddl_rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    (ddl_rows.repartitionByRange(n, "batch", "table_name", "position")
     .sortWithinPartitions("batch", "table_name", "position")
     .write.mode("overwrite").partitionBy("batch", "table_name").json(path))


def write_text_bundle(files: DataFrame, path: str, content: str = "content", kind: str = "file_type") -> None:
    """K5: the files whose status is ok, as text, one folder per file type
    and path, so that every body keeps its name."""
    ok = files.where(F.col("status") == "ok")
    named = [F.col(kind)] + ([F.col("path")] if "path" in files.columns else [])
    ok.select(*named, F.col(content).alias("value")).write.mode("overwrite").partitionBy(
        *[c for c in (kind, "path") if c in files.columns]).text(path)


def append_audit(record: DataFrame, path: str) -> None:
    """K6: append audit rows (JSON lines)."""
    record.write.mode("append").json(path)


def write_audited(df: DataFrame, write: Callable[[DataFrame], None], audit_path: str, module: str, source: str,
                  query: str, user_action: str | None = None) -> dict:
    """K6: run ``write`` on ``df`` and append its audit row; the row count is observed while the rows are written,
    so nothing is read or computed a second time.  Returns ``row_count`` and ``duration_ms``.  If ``write``
    fails there is no audit row; one that runs several jobs over the frame counts the first."""
    seen = Observation()
    begun = time.monotonic()
    write(df.observe(seen, F.count(F.lit(1)).alias("row_count")))
    out = {"row_count": seen.get["row_count"], "duration_ms": round((time.monotonic() - begun) * 1000)}
    append_audit(df.sparkSession.range(1).select(
        F.current_timestamp().alias("timestamp"), F.lit(module).alias("module"), F.lit(source).alias("source"),
        F.lit(query).alias("query"), F.lit(out["row_count"]).cast("long").alias("row_count"),
        F.lit(out["duration_ms"]).cast("long").alias("duration_ms"), F.lit(user_action).alias("user_action")), audit_path)
    return out


def write_version(df: DataFrame, base: str, version: int | None = None, mode: str = "errorifexists") -> str:
    """K7/K8: write the next version of a store or snapshot under base/v=<n> and return
    its path (a reader of the previous version is never disturbed)."""
    v = version if version is not None else int(time.time() * 1000)
    out = f"{base.rstrip('/')}/v={v}"
    df.write.mode(mode).parquet(out)
    return out


def latest_version(spark, base: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version written by ``write_version`` (None when there is none).  Only
    that version's folder is read; a folder without a success mark is still being written.
    ``before``: only versions below it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [(int(m[1]), st.getPath().toString()) for st in fs.listStatus(path)
             if (m := re.fullmatch(r"v=(\d+)", st.getPath().getName()))
             and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]
    found = [f for f in found if before is None or f[0] < before]
    return spark.read.parquet(max(found)[1]) if found else None
