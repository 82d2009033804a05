"""Task health per event-time window.  The same function serves a batch DataFrame
(registered query, oracle-checked) and a streaming one (watermark + append mode: a
window is emitted once the watermark passes its end; later rows are dropped)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import health_status_exact
from ..operators.runs import DURATION_DECIMAL, exact_avg


def health_windows(ti: DataFrame, window: str = "1 day", thresholds: dict | None = None,
                   watermark: str | None = None, ts: str = "start_date") -> DataFrame:
    """Per (window, dag, task): instances, non-null durations, average duration, success
    rate and the health label of that window."""
    d = ti.withWatermark(ts, watermark) if watermark else ti
    g = d.groupBy(F.window(ts, window).alias("w"), "dag_id", "task_id").agg(
        F.count(F.lit(1)).alias("instances"),
        F.count("duration_s").alias("runs"),
        F.sum(F.col("duration_s").cast(DURATION_DECIMAL)).alias("_sum"),
        F.count_if(F.col("state") == "success").alias("_ok"))
    return g.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "dag_id", "task_id",
        F.col("instances").cast("long"), F.col("runs").cast("long"),
        exact_avg("_sum", "runs", 2).alias("avg_duration_s"),
        F.round(F.col("_ok").cast("decimal(20,0)") / F.col("instances"), 3).cast("double").alias("success_rate"),
        F.when(F.col("runs") > 0, health_status_exact("_sum", "runs", "_ok", "instances", thresholds))
        .alias("health_status"))
