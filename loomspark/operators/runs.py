"""Run and task analytics over DAG runs, task instances and task logs
(A1, A5, W1–W9, P7, O1, Q9–Q13)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefmt import duration_seconds
from ..functions.types import HEALTH_SEVERITY, health_status_exact
from .ranks import kth_smallest

FAILED_STATES = ("failed", "upstream_failed")
# fixed values: keywords that mark an error line (the log form adds CRITICAL)
ERROR_KEYWORDS = ("ERROR", "Traceback", "Exception")
LOG_ERROR_KEYWORDS = ("ERROR", "CRITICAL", "Traceback", "Exception")


# durations are summed as exact decimals at microsecond precision
DURATION_DECIMAL = "decimal(24,6)"


def exact_avg(total, count, digits: int):
    """Exact decimal total / count rounded half-up to ``digits`` (as double)."""
    return F.round(F.col(total) / F.col(count), digits).cast("double")


def task_performance(ti: DataFrame, thresholds: dict | None = None,
                     group: Sequence[str] = ("dag_id", "task_id"),
                     duration: str = "duration_s", state: str = "state",
                     runs: DataFrame | None = None, last_runs: int | None = None) -> DataFrame:
    """Per task: avg/max/p95 of non-null durations, success rate over all instances,
    run_count = non-null durations; tasks without any duration are dropped.
    p95 is the element at 0-based index floor(0.95·n) of the ascending durations.
    Averages are exact decimals (microseconds) rounded half-up; health is decided on the
    unrounded values (exactly, without division). Output rounds 2/2/2/3.  With ``runs`` and
    ``last_runs``, only instances of each DAG's newest runs count (the reference's limit)."""
    group = list(group)
    if runs is not None and last_runs is not None:
        # only the instances of each DAG's newest ``last_runs`` runs (runs: dag_id, run_id,
        # logical_date, run_key)
        newest = recent_runs(runs, last_runs).select("dag_id", "run_id")
        ti = ti.join(newest, ["dag_id", "run_id"], "left_semi")
    stats = (ti.groupBy(*group).agg(
        F.sum(F.col(duration).cast(DURATION_DECIMAL)).alias("_sum"),
        F.max(duration).alias("_max"),
        F.count(duration).alias("run_count"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(state) == "success").alias("_ok"))
        .where(F.col("run_count") > 0))
    k = stats.select(*group, (F.floor(F.col("run_count") * F.lit(0.95)) + 1).alias("_k"))
    p95 = kth_smallest(ti.select(*group, duration), group, duration, k, out="_p95")
    return (stats.join(p95, group).select(
        *group,
        exact_avg("_sum", "run_count", 2).alias("avg_duration_s"),
        F.round("_max", 2).alias("max_duration_s"),
        F.round("_p95", 2).alias("p95_duration_s"),
        F.round(F.col("_ok").cast("decimal(20,0)") / F.col("_n"), 3).cast("double").alias("success_rate"),
        F.col("run_count").cast("long").alias("run_count"),
        health_status_exact("_sum", "run_count", "_ok", "_n", thresholds).alias("health_status")))


def health_rollup(perf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count of tasks per health status (all three listed, zero-filled) and the
    overall (worst present) status."""
    by = list(by)
    sev = F.create_map(*[F.lit(x) for kv in HEALTH_SEVERITY.items() for x in kv])
    agg = perf.groupBy(*by).agg(
        *[F.count_if(F.col("health_status") == s).cast("long").alias(s) for s in HEALTH_SEVERITY],
        F.max(F.element_at(sev, F.col("health_status"))).alias("_worst"))
    inv = F.create_map(*[F.lit(x) for kv in HEALTH_SEVERITY.items() for x in kv[::-1]])
    return agg.select(*by, *HEALTH_SEVERITY.keys(),
                      F.element_at(inv, F.col("_worst")).alias("overall_health"))


def with_duration(runs: DataFrame, start: str = "start_date", end: str = "end_date",
                  out: str = "duration_s") -> DataFrame:
    return runs.withColumn(out, duration_seconds(start, end))


def recent_runs(runs: DataFrame, n: int, partition: Sequence[str] = ("dag_id",),
                order: str = "logical_date", tie: str = "run_key", rank_col: str = "recency") -> DataFrame:
    """Newest ``n`` runs per partition (rank 1 = newest). Expressed as a rank filter, so
    Spark inserts a per-partition group limit before the shuffle: a hot DAG costs n rows
    per map task, not its whole history."""
    w = Window.partitionBy(*partition).orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc())
    return runs.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def run_history(runs: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` runs per DAG with duration; run_number counts N…1 from newest to oldest."""
    r = recent_runs(with_duration(runs), n)
    w = Window.partitionBy("dag_id").orderBy(F.col("logical_date").asc(), F.col("run_key").asc())
    return r.select(
        "dag_id", "run_id", "logical_date",
        F.col("start_date").alias("start_time"), F.col("end_date").alias("end_time"),
        "duration_s", F.col("state").alias("status"), F.col("run_type").alias("triggered_by"),
        F.row_number().over(w).cast("long").alias("run_number"))


def trend_points(history: DataFrame) -> DataFrame:
    """(run_number, duration) points with a numeric duration only (bad values → dropped)."""
    d = F.col("duration_s").cast("string").try_cast("double")
    return history.select("dag_id", "run_number", d.alias("duration_s")).where(F.col("duration_s").isNotNull())


def jobs(runs: DataFrame, dag_id: str | None = None, limit: int = 20, per_dag: int = 5) -> DataFrame:
    """One DAG: its newest ``limit`` runs. All DAGs: newest ``per_dag`` per DAG, then the global
    top ``limit`` by start time (missing last). Both orders end in run_key for determinism."""
    r = with_duration(runs)
    if dag_id is not None:
        r = recent_runs(r.where(F.col("dag_id") == dag_id), limit)
    else:
        r = recent_runs(r, per_dag)
    out = r.select("dag_id", "run_id", "run_key", "state",
                   F.col("start_date").alias("start_time"), F.col("end_date").alias("end_time"),
                   "duration_s", F.col("run_type").alias("triggered_by"), "logical_date")
    out = out.orderBy(F.col("start_time").desc_nulls_last(), F.col("run_key").desc())
    return out if dag_id is not None else out.limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run per DAG with its state, start and end (map-side combined ``max_by``)."""
    order = F.struct(F.col("logical_date"), F.col("run_key"))
    payload = F.struct("run_id", "state", "start_date", "end_date", "logical_date")
    return (runs.groupBy("dag_id").agg(F.max_by(payload, order).alias("r"))
            .select("dag_id", "r.run_id", "r.state", "r.start_date", "r.end_date", "r.logical_date"))


def failed_tasks(ti: DataFrame, task_id: str | None = None) -> DataFrame:
    cond = F.col("state").isin(*FAILED_STATES)
    if task_id is not None:
        cond = cond & (F.col("task_id") == task_id)
    return ti.where(cond)


def first_failed(ti: DataFrame, n: int = 5, run: Sequence[str] = ("dag_id", "run_id"),
                 order: str = "event_id") -> DataFrame:
    """First ``n`` failed task instances per run in payload order."""
    w = Window.partitionBy(*run).orderBy(F.col(order))
    return (failed_tasks(ti).withColumn("position", F.row_number().over(w).cast("long"))
            .where(F.col("position") <= n))


def error_lines(lines: DataFrame, keywords: Sequence[str] = ERROR_KEYWORDS, line: str = "line") -> DataFrame:
    """Lines containing any keyword (case-sensitive substring)."""
    cond = None
    for kw in keywords:
        c = F.col(line).contains(kw)
        cond = c if cond is None else (cond | c)
    return lines.where(cond)


def tail_lines(lines: DataFrame, n: int = 50, log: Sequence[str] = ("log_id",),
               line_no: str = "line_no") -> DataFrame:
    """Last ``n`` lines of every log."""
    w = Window.partitionBy(*log).orderBy(F.col(line_no).desc())
    return lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def tail_array(arr, n: int = 50):
    """Array form of the tail: the last n elements, also for shorter arrays."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), n)


def log_summary(lines: DataFrame, keywords: Sequence[str] = LOG_ERROR_KEYWORDS,
                log: Sequence[str] = ("log_id",)) -> DataFrame:
    """Per log: line count and error-line count (the task level of the execution log)."""
    cond = None
    for kw in keywords:
        c = F.col("line").contains(kw)
        cond = c if cond is None else (cond | c)
    return lines.groupBy(*log).agg(F.count(F.lit(1)).alias("line_count"),
                                   F.count_if(cond).cast("long").alias("error_count"))


def error_report(ti: DataFrame, logs: DataFrame, n_failed: int = 5, n_tail: int = 50,
                 keys: Sequence[str] = ("dag_id", "run_id", "task_id")) -> DataFrame:
    """Q13: for the first ``n_failed`` failed instances of every run, the last ``n_tail``
    lines of their task log, each flagged when it is an error line."""
    keys = list(keys)
    failed = first_failed(ti, n_failed).select(*keys, "state", "position").dropDuplicates(keys)
    tail = tail_lines(logs.join(failed.select(*keys), keys, "left_semi"), n_tail, log=keys)
    cond = None
    for kw in ERROR_KEYWORDS:
        c = F.col("line").contains(kw)
        cond = c if cond is None else (cond | c)
    return failed.join(tail, keys).select(*keys, "state", "position", "line_no", "line", cond.alias("is_error"))


def execution_log(runs: DataFrame, ti: DataFrame, lines: DataFrame, dag_id: str,
                  run_id: str | None = None, task_id: str | None = None, n_runs: int = 20) -> DataFrame:
    """Q12 at the level the arguments select:
    DAG only → its newest ``n_runs`` runs with durations;
    DAG + run → that run's task instances with durations;
    DAG + run + task → every log line, flagged when it is an error line (the log form
    counts CRITICAL too), with the error count of the log on each row."""
    if run_id is None:
        return run_history(runs.where(F.col("dag_id") == dag_id), n=n_runs)
    inst = ti.where((F.col("dag_id") == dag_id) & (F.col("run_id") == run_id))
    if task_id is None:
        return inst.select("task_id", "state", "start_date", "end_date",
                           duration_seconds("start_date", "end_date").alias("duration_s"), "try_number", "operator")
    cond = None
    for kw in LOG_ERROR_KEYWORDS:
        c = F.col("line").contains(kw)
        cond = c if cond is None else (cond | c)
    keys = ["dag_id", "run_id", "task_id"]
    sel = lines.where((F.col("dag_id") == dag_id) & (F.col("run_id") == run_id) & (F.col("task_id") == task_id))
    flagged = sel.select(*keys, "line_no", "line", cond.alias("is_error"))
    totals = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("line_count"),
                                        F.count_if("is_error").alias("error_count"))
    # the per-log totals (one row) join back on the log's key
    return flagged.join(totals, keys).select("line_no", "line", "is_error", "line_count", "error_count")
