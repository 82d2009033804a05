"""Task graphs and lineage.

Edges are rows (dag_id, src, dst); roots are an anti-join; reachability/depth is a
breadth-first loop of joins with an anti-join against the visited set, so cycles stop
and no path is ever enumerated twice.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import path_stem
from ..functions.timefmt import duration_seconds
from ..session import cut_lineage, stored
from .runs import latest_run, recent_runs


def task_edges(tasks: DataFrame) -> DataFrame:
    """task → downstream edges (the field the scheduler calls downstream_task_ids)."""
    return tasks.select("dag_id", F.col("task_id").alias("src"),
                        F.explode("downstream_task_ids").alias("dst"))


def root_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that are nobody's downstream (left anti join; no NOT IN null trap)."""
    e = task_edges(tasks).select("dag_id", F.col("dst").alias("task_id"))
    return tasks.join(e, ["dag_id", "task_id"], "left_anti")


def trigger_target(operator, trigger_dag_id, conf=None, params=None):
    """child DAG of a TriggerDagRun task: trigger_dag_id, else conf, else params.value."""
    cands = [F.col(trigger_dag_id) if isinstance(trigger_dag_id, str) else trigger_dag_id]
    if conf is not None:
        cands.append(F.get_json_object(F.col(conf), "$.trigger_dag_id"))
    if params is not None:
        cands.append(F.get_json_object(F.col(params), "$.trigger_dag_id.value"))
    return F.when(F.col(operator).contains("TriggerDagRun"), F.coalesce(*[F.nullif(c, F.lit("")) for c in cands]))


def _trigger(tasks: DataFrame):
    """F39 with every branch the task table has a column for."""
    return trigger_target("operator", "trigger_dag_id", *[c if c in tasks.columns else None for c in ("conf", "params")])


def child_dag_edges(tasks: DataFrame) -> DataFrame:
    """Parent DAG → triggered DAG, deduplicated per parent."""
    t = tasks.select("dag_id", _trigger(tasks).alias("child_dag_id"))
    return t.where(F.col("child_dag_id").isNotNull()).dropDuplicates(["dag_id", "child_dag_id"])


def task_graph(tasks: DataFrame, runs: DataFrame, instances: DataFrame,
               run_id: str | None = None) -> DataFrame:
    """Q14: every task of every DAG with the state of its instance in the chosen run (the
    latest run per DAG unless ``run_id`` is given).  Duration is end − start, falling back
    to the stored duration when that is missing or zero.  Instances of one task in one run:
    the last in ``seq`` order wins."""
    if run_id is None:
        run = latest_run(runs).select("dag_id", "run_id", F.col("state").alias("run_state"),
                                      F.col("start_date").alias("run_start"), F.col("end_date").alias("run_end"))
    else:
        run = runs.where(F.col("run_id") == run_id).select(
            "dag_id", "run_id", F.col("state").alias("run_state"),
            F.col("start_date").alias("run_start"), F.col("end_date").alias("run_end"))
    inst = (instances.join(run.select("dag_id", "run_id"), ["dag_id", "run_id"], "left_semi")
            .groupBy("dag_id", "run_id", "task_id")
            .agg(F.max_by(F.struct("state", "start_date", "end_date", "duration", "try_number"), "seq").alias("i")))
    computed = duration_seconds("i.start_date", "i.end_date")
    dur = F.when(computed.isNull() | (computed == 0), F.col("i.duration")).otherwise(computed)
    return (tasks.withColumn("_child", _trigger(tasks)).join(run, "dag_id", "left")
            .join(inst, ["dag_id", "run_id", "task_id"], "left")
            .select("dag_id", "run_id", "run_state", "task_id", "operator",
                    F.array_join("downstream_task_ids", ", ").alias("downstream"),
                    F.col("i.state").alias("state"), F.col("i.start_date").alias("start_time"),
                    F.col("i.end_date").alias("end_time"), dur.alias("duration_s"),
                    F.col("i.try_number").alias("try_number"),
                    F.col("_child").alias("trigger_dag_id")))


def sql_coverage(tasks: DataFrame) -> DataFrame:
    """Tasks and tasks with SQL per DAG."""
    return tasks.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.coalesce(F.length(F.trim("sql")), F.lit(0)) > 0).alias("tasks_with_sql"))


def lineage_edges(mapping: DataFrame, tasks: DataFrame) -> DataFrame:
    """G1: workbook → DAG (from the mapping's dag_names, each edge once), DAG → root tasks only,
    task → downstream, task → SQL (when the task has SQL)."""
    wb = mapping.select(F.concat(F.lit("excel:"), F.col("raw_name")).alias("src"),
                        F.explode("dag_names").alias("dag_id"))
    wb = wb.select("src", F.concat(F.lit("dag:"), F.col("dag_id")).alias("dst"), F.lit("excel_dag").alias("kind")).distinct()
    node = lambda d, t: F.concat(F.lit("task:"), d, F.lit("."), t)
    roots = root_tasks(tasks).select(F.concat(F.lit("dag:"), F.col("dag_id")).alias("src"),
                                     node(F.col("dag_id"), F.col("task_id")).alias("dst"),
                                     F.lit("dag_task").alias("kind"))
    down = task_edges(tasks).select(node(F.col("dag_id"), F.col("src")).alias("src"),
                                    node(F.col("dag_id"), F.col("dst")).alias("dst"),
                                    F.lit("task_task").alias("kind"))
    sql = (tasks.where(F.coalesce(F.length(F.trim("sql")), F.lit(0)) > 0)
           .select(node(F.col("dag_id"), F.col("task_id")).alias("src"),
                   F.concat(F.lit("sql:"), F.col("dag_id"), F.lit("."), F.col("task_id")).alias("dst"),
                   F.lit("task_sql").alias("kind")))
    return wb.unionByName(roots).unionByName(down).unionByName(sql)


def lineage_nodes(mapping: DataFrame, tasks: DataFrame) -> DataFrame:
    """G1: the nodes of ``lineage_edges`` — ``id``, ``type`` (excel, dag, task, sql), ``label`` and the
    ``detail`` a reader wants first: target table, operator or the SQL text.  Of several rows of one workbook the last
    by the mapping's ``seq`` counts, then (and without one) the greatest target table; of repeated tasks the
    greatest operator and SQL text."""
    none = F.lit(None).cast("string")
    excel = mapping.select(F.concat(F.lit("excel:"), F.col("raw_name")).alias("id"), F.lit("excel").alias("type"),
                           F.col("raw_name").alias("label"), F.col("bq_table").alias("detail"),
                           (F.col("seq") if "seq" in mapping.columns else F.lit(0)).cast("long").alias("seq"))
    dags = (mapping.select(F.explode("dag_names").alias("dag_id")).unionByName(tasks.select("dag_id")).distinct()
            .select(F.concat(F.lit("dag:"), F.col("dag_id")).alias("id"), F.lit("dag").alias("type"),
                    F.col("dag_id").alias("label"), none.alias("detail")))
    name = F.concat(F.col("dag_id"), F.lit("."), F.col("task_id"))
    task = tasks.select(F.concat(F.lit("task:"), name).alias("id"), F.lit("task").alias("type"),
                        F.col("task_id").alias("label"), F.col("operator").alias("detail"))
    sql = tasks.where(F.length(F.trim("sql")) > 0).select(
        F.concat(F.lit("sql:"), name).alias("id"), F.lit("sql").alias("type"), F.col("task_id").alias("label"),
        F.col("sql").alias("detail"))
    every = excel.unionByName(dags.unionByName(task).unionByName(sql).withColumn("seq", F.lit(0).cast("long")))
    return every.groupBy("id").agg(F.max(F.struct("seq", "detail", "type", "label")).alias("n")).select(
        "id", "n.type", "n.label", "n.detail")


def task_depth(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shortest depth of every node reachable from a root (a node that is nobody's dst).

    Breadth-first: frontier ⋈ edges, minus every node already visited.  Each level is
    written with a reliable checkpoint, and the visited set is the plain union of those
    level tables, so each level's plan stays small (no lineage chain) and a lost executor
    only recomputes one level.  The loop stops when a level adds nothing, so cycles cannot
    loop; nodes that lie only on cycles are not returned."""
    e = cut_lineage(edges.select("dag_id", F.col("src").alias("task_id"), F.col("dst").alias("_dst"))
                    .dropDuplicates())
    roots = nodes.select("dag_id", "task_id").join(
        e.select("dag_id", F.col("_dst").alias("task_id")).hint("merge"), ["dag_id", "task_id"], "left_anti")
    frontier = cut_lineage(roots.select("dag_id", "task_id", F.lit(0).alias("depth")).dropDuplicates())
    levels = [frontier]
    level = 0
    while True:
        level += 1
        seen = levels[0].select("dag_id", "task_id")
        for lv in levels[1:]:
            seen = seen.unionByName(lv.select("dag_id", "task_id"))
        # merge joins: levels are sent from task to task, none of them through the driver
        nxt = (frontier.select("dag_id", "task_id").hint("merge").join(e, ["dag_id", "task_id"])
               .select("dag_id", F.col("_dst").alias("task_id")).dropDuplicates()
               .join(seen.hint("merge"), ["dag_id", "task_id"], "left_anti")
               .select("dag_id", "task_id", F.lit(level).alias("depth")))
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        frontier = nxt
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


# ── lookups and the trace from a mapping file to runs, tasks and SQL ────────────

def _pieces(text, length: int):
    """All distinct ``length``-letter substrings of a string column."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (length - 1), F.lit(1))),
        lambda i: F.substr(text, i, length if isinstance(length, Column) else F.lit(length))))


def lookup_first(registry: DataFrame, needles: DataFrame, fields: Sequence[str] = ("file_path", "table_name"),
                 pos: str = "pos", gram: int = 3) -> DataFrame:
    """Per needle, the first registry entry (smallest ``pos``) whose fields contain
    the needle, case-insensitively.

    A substring match is a theta join.  To keep both sides distributed it becomes an
    equi-join: registry text is cut into ``gram``-letter pieces, and each needle is joined on
    the two of its own pieces that are rarest in the registry (every true match contains
    both).  Only (piece, ``pos``) pairs are shuffled; the text is fetched for the candidates
    that have both and confirmed with ``contains``.  Needles shorter than ``gram`` use pieces
    of their own length.  Needles with no match keep null fields."""
    hay = registry.select(pos, F.lower(F.concat_ws("\u0001", *[F.coalesce(F.col(f), F.lit("")) for f in fields])).alias("_hay"))
    n = (needles.select("needle").dropDuplicates(["needle"])
         .withColumn("_n", F.lower("needle")).where(F.length("_n") > 0))
    # one pass per piece length: a needle's pieces are as long as it is, up to ``gram``
    n = n.withColumn("_size", F.least(F.length("_n"), F.lit(gram)))
    sizes = F.array(*[F.lit(i) for i in range(1, gram + 1)])
    cut = lambda text, size: F.explode(F.transform(_pieces(F.col(text), size), lambda g: g)).alias("_g")
    own = n.select("needle", "_size", cut("_n", F.col("_size")))
    # only the piece lengths that some needle has are cut from the registry
    used = own.select("_size").distinct()
    pieces = (hay.select(pos, "_hay", F.explode(sizes).alias("_size")).join(F.broadcast(used), "_size", "left_semi")
              .select(pos, cut("_hay", F.col("_size"))))  # at most ``gram`` sizes
    wanted = pieces.join(own.select("_g").distinct(), "_g", "left_semi")
    freq = wanted.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    rare = (own.join(freq, "_g", "left").groupBy("needle")
            .agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "_g"))), 1, 2).alias("_r"))
            .where(F.col("_r")[0]["f"] > 0))
    have = lambda i: (rare.select("needle", F.coalesce(F.get("_r", F.lit(i))["_g"], F.col("_r")[0]["_g"]).alias("_g"))
                      .join(wanted, "_g").select("needle", pos))
    cand = have(0).join(have(1), ["needle", pos]).distinct()
    first = (cand.join(hay, pos).where(F.col("_hay").contains(F.lower("needle")))
             .groupBy("needle").agg(F.min(pos).alias(pos)))
    return n.select("needle").join(first, "needle", "left").join(registry, pos, "left")


def mapping_lookup(entries: DataFrame, config: DataFrame) -> DataFrame:
    """Entry ⟕ mapping config on the file stem, else on the lower-cased stem; the
    mapping's non-empty bq_table / dag_names beat the entry's own."""
    e = entries.withColumn("_stem", path_stem("file_path"))
    c = config.select(F.col("stem").alias("_k"), F.col("bq_table").alias("_bq"),
                      F.when(F.size("dag_names") > 0, F.col("dag_names")).alias("_dags"))
    exact = c.select(F.col("_k").alias("_stem"), F.col("_bq").alias("_bq1"), F.col("_dags").alias("_d1"),
                     F.lit(True).alias("_in1"))
    lower = c.select(F.col("_k").alias("_lstem"), F.col("_bq").alias("_bq2"), F.col("_dags").alias("_d2"))
    j = (e.join(exact, "_stem", "left").withColumn("_lstem", F.lower("_stem"))
         .join(lower, "_lstem", "left"))
    hit1 = F.col("_in1").isNotNull()
    bq = F.when(hit1, F.col("_bq1")).otherwise(F.col("_bq2"))
    dags = F.when(hit1, F.col("_d1")).otherwise(F.col("_d2"))
    has_own = "bq_table" in entries.columns
    bq_out = F.coalesce(F.nullif(bq, F.lit("")), F.col("bq_table")) if has_own else bq
    own = [F.col("dag_names")] if "dag_names" in entries.columns else []
    return j.withColumn("bq_table", bq_out).withColumn(
        "dag_names", F.coalesce(dags, *own, F.array().cast("array<string>"))) \
        .drop("_stem", "_lstem", "_bq1", "_d1", "_in1", "_bq2", "_d2")


def _traced_dags(needles: DataFrame, registry: DataFrame, config: DataFrame) -> DataFrame:
    """(needle, pos, table_name, bq_table, dag_id): the first workbook of each needle and the DAGs of
    its mapping; a null ``pos`` where no workbook matches, a null ``dag_id`` where no DAG is listed."""
    wb = lookup_first(registry, needles)
    mapped = mapping_lookup(wb.where(F.col("pos").isNotNull()), config)
    out = mapped.select("needle", "pos", "table_name", "bq_table", F.explode_outer("dag_names").alias("dag_id"))
    none = wb.where(F.col("pos").isNull()).select("needle", "pos", *[
        F.lit(None).cast("string").alias(c) for c in ("table_name", "bq_table", "dag_id")])
    return out.unionByName(none)


def trace(needles: DataFrame, registry: DataFrame, config: DataFrame, runs: DataFrame,
          tasks: DataFrame, instances: DataFrame, n_runs: int = 5) -> DataFrame:
    """Q16 (batch form): for any number of mapping names at once →
    workbook (first registry match) → mapping (target table, DAGs) → each DAG's newest
    ``n_runs`` runs by start date, with task counts, failed tasks and tasks with SQL.
    status: no_excel (the registry is empty), not_found (no workbook matches), no_dag (the
    mapping lists no DAG), no_runs (a listed DAG has none), ok."""
    per_dag = _traced_dags(needles, registry, config)
    recent = recent_runs(runs, n_runs, order="start_date").select("dag_id", "run_id", "state", "recency")
    tstat = (instances.join(recent.select("dag_id", "run_id"), ["dag_id", "run_id"], "left_semi")
             .groupBy("dag_id", "run_id").agg(
                 F.count_distinct("task_id").alias("tasks_run"),
                 F.count_distinct(F.when(F.col("state") == "failed", F.col("task_id"))).alias("tasks_failed")))
    out = (per_dag.join(recent, "dag_id", "left").join(tstat, ["dag_id", "run_id"], "left")
           .join(sql_coverage(tasks), "dag_id", "left"))
    status = (F.when(F.col("pos").isNull(), "no_excel" if registry.isEmpty() else "not_found")
              .when(F.col("dag_id").isNull(), "no_dag").when(F.col("run_id").isNull(), "no_runs").otherwise("ok"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tasks_run", "tasks_failed", "tasks", "tasks_with_sql")]
    return out.select("needle", "table_name", "bq_table", "dag_id", "run_id", F.col("state").alias("run_state"),
                      F.col("recency").cast("long").alias("recency"), *counts, status.alias("status"))


def trace_runs(needles: DataFrame, registry: DataFrame, config: DataFrame, runs: DataFrame,
               n_runs: int = 5) -> DataFrame:
    """Q16, runs: per needle and DAG the newest ``n_runs`` runs by start date with durations."""
    recent = recent_runs(runs, n_runs, order="start_date")
    return (_traced_dags(needles, registry, config).where(F.col("dag_id").isNotNull()).select("needle", "dag_id")
            .join(recent, "dag_id").select(
                "needle", "dag_id", "recency", "run_id", "state", F.col("start_date").alias("start_time"),
                F.col("end_date").alias("end_time"), duration_seconds("start_date", "end_date").alias("duration_s")))


def trace_tasks(needles: DataFrame, registry: DataFrame, config: DataFrame, runs: DataFrame,
                tasks: DataFrame, instances: DataFrame) -> DataFrame:
    """Q16, tasks: per needle and DAG every task with the state and stored duration of its instance
    in the DAG's newest run by start date (of several instances the last in ``seq`` order)."""
    last = recent_runs(runs, 1, order="start_date").select("dag_id", "run_id")
    inst = (instances.join(last, ["dag_id", "run_id"], "left_semi").groupBy("dag_id", "task_id")
            .agg(F.max_by(F.struct("run_id", "state", "duration"), "seq").alias("i")))
    return (_traced_dags(needles, registry, config).where(F.col("dag_id").isNotNull()).select("needle", "dag_id")
            .join(tasks, "dag_id").join(inst, ["dag_id", "task_id"], "left").select(
                "needle", "dag_id", "task_id", "operator", F.array_join("downstream_task_ids", ", ").alias("downstream"),
                F.col("i.run_id").alias("run_id"), F.col("i.state").alias("state"),
                F.col("i.duration").alias("duration_s")))


def trace_sql(needles: DataFrame, registry: DataFrame, config: DataFrame, runs: DataFrame,
              tasks: DataFrame, rendered: DataFrame, n_runs: int = 10, files: DataFrame | None = None) -> DataFrame:
    """Q16, SQL: per needle and DAG the best SQL of every task that has some."""
    best = task_sql(tasks, runs, rendered, n_runs, files).where(F.length("best_sql") > 0)
    return (_traced_dags(needles, registry, config).where(F.col("dag_id").isNotNull()).select("needle", "dag_id")
            .join(best, "dag_id").select("needle", "dag_id", "task_id", "best_sql"))


def rendered_from_fields(instances: DataFrame, fields: str = "rendered_fields") -> DataFrame:
    """Instances with ``rendered_sql`` and ``truncated`` read from their rendered-fields JSON: the SQL
    found in it (F15), else what is left of a truncated repr (F17, F18)."""
    from ..functions import sqltext as T
    inner = T.unwrap_rendered(fields)
    cut = T.salvage_truncated_sql(F.get_json_object(inner, "$.configuration"))
    truncated = T.is_truncated(fields)
    return instances.withColumns({
        "rendered_sql": F.when(truncated, cut).otherwise(T.extract_sql(inner)), "truncated": truncated})


def raw_task_sql(tasks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(dag_id, task_id, raw_sql) from task definitions (JSON text in ``definition``): the content of the
    .sql file a definition names (F16) — ``files`` holds ``rel_path``, ``content`` and, where a path
    exists below several roots, ``root_order``: the first root that has text — else the SQL in the
    definition itself (F15).  Tasks without a definition column keep their ``sql``."""
    from ..functions import sqltext as T
    if "definition" not in tasks.columns:
        return tasks.select("dag_id", "task_id", F.col("sql").alias("raw_sql"))
    t = tasks.select("dag_id", "task_id", T.sql_file_ref("definition").alias("rel_path"),
                     T.extract_sql("definition").alias("_own"))
    if files is None:
        return t.select("dag_id", "task_id", F.col("_own").alias("raw_sql"))
    order = F.col("root_order") if "root_order" in files.columns else F.lit(0)
    first = (files.where(F.length("content") > 0).join(t.select("rel_path").distinct(), "rel_path", "left_semi")
             .groupBy("rel_path").agg(F.min_by("content", order).alias("content")))
    # in a join, tasks that name no file would all meet in the task of the null key
    named = t.where(F.col("rel_path").isNotNull()).join(first, "rel_path", "left")
    return named.select("dag_id", "task_id", F.coalesce("content", "_own").alias("raw_sql")).unionByName(
        t.where(F.col("rel_path").isNull()).select("dag_id", "task_id", F.col("_own").alias("raw_sql")))


def latest_task_sql(runs: DataFrame, rendered: DataFrame, n_runs: int = 10) -> DataFrame:
    """W3 (batch form): per (dag, task), among the DAG's newest ``n_runs`` successful runs,
    the newest run in which the task rendered SQL.  The instance of a task in a run is the
    last one in ``seq`` order.  ``truncated`` comes along where the instances have it."""
    # written first: its real size decides whether instances are filtered where they are read or meet it by a shuffle
    ok = stored(recent_runs(runs.where(F.col("state") == "success"), n_runs).select("dag_id", "run_id", "logical_date", "run_key"))
    more = ["truncated"] if "truncated" in rendered.columns else []
    inst = (rendered.join(ok.select("dag_id", "run_id"), ["dag_id", "run_id"], "left_semi")
            .groupBy("dag_id", "run_id", "task_id")
            .agg(F.max_by(F.struct("rendered_sql", *more), "seq").alias("i")).select("dag_id", "run_id", "task_id", "i.*"))
    with_sql = inst.where(F.coalesce(F.length(F.trim("rendered_sql")), F.lit(0)) > 0)
    order = ok.select("dag_id", "run_id", F.struct(F.col("logical_date"), F.col("run_key")).alias("_o"))
    return (with_sql.join(order, ["dag_id", "run_id"])
            .groupBy("dag_id", "task_id")
            .agg(F.max_by(F.struct("run_id", "rendered_sql", *more), "_o").alias("r"))
            .select("dag_id", "task_id", "r.run_id", "r.rendered_sql", *[f"r.{c}" for c in more]))


def one_task_sql(runs: DataFrame, rendered: DataFrame, dag_id: str, task_id: str, n_runs: int = 10) -> DataFrame:
    """W3 (single task): the task's instance in the newest of ``n_runs`` successful runs that holds the
    task at all, with or without SQL."""
    ok = recent_runs(runs.where((F.col("state") == "success") & (F.col("dag_id") == dag_id)), n_runs)
    inst = rendered.where((F.col("dag_id") == dag_id) & (F.col("task_id") == task_id))
    return (inst.join(ok.select("dag_id", "run_id", "recency"), ["dag_id", "run_id"])
            .orderBy("recency", F.desc("seq")).limit(1).select("dag_id", "task_id", "run_id", "rendered_sql"))


def task_sql(tasks: DataFrame, runs: DataFrame, rendered: DataFrame, n_runs: int = 10,
             files: DataFrame | None = None) -> DataFrame:
    """Q15: raw SQL of the definition or of the file it names, the newest rendered SQL (W3) and the
    better of the two (F19: a truncated rendering never beats raw SQL)."""
    from ..functions.sqltext import best_sql
    if "rendered_sql" not in rendered.columns:
        rendered = rendered_from_fields(rendered)
    r = latest_task_sql(runs, rendered, n_runs)
    cut = F.coalesce("truncated", F.lit(False)) if "truncated" in r.columns else F.lit(False)
    return (raw_task_sql(tasks, files).join(r, ["dag_id", "task_id"], "left")
            .select("dag_id", "task_id", "raw_sql", "run_id", "rendered_sql",
                    best_sql("raw_sql", "rendered_sql", cut).alias("best_sql")))


def task_depth_recursive(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G3 for small graphs in one SQL statement: a recursive CTE walks from the roots,
    carrying the path so a cycle is never re-entered, then keeps the shortest depth per
    node.  Paths are enumerated, so use ``task_depth`` (breadth-first) for large or very
    branchy graphs; the depth itself has no limit."""
    spark = edges.sparkSession
    edges.select("dag_id", "src", "dst").createOrReplaceTempView("_ls_edges")
    nodes.select("dag_id", "task_id").createOrReplaceTempView("_ls_nodes")
    return spark.sql("""
        WITH RECURSIVE walk(dag_id, task_id, depth, path) MAX RECURSION LEVEL 2147483647 AS (
          SELECT n.dag_id, n.task_id, 0, array(n.task_id) FROM _ls_nodes n
          WHERE NOT EXISTS (SELECT 1 FROM _ls_edges e WHERE e.dag_id = n.dag_id AND e.dst = n.task_id)
          UNION ALL
          SELECT e.dag_id, e.dst, w.depth + 1, concat(w.path, array(e.dst))
          FROM walk w JOIN _ls_edges e ON e.dag_id = w.dag_id AND e.src = w.task_id
          WHERE NOT array_contains(w.path, e.dst))
        SELECT dag_id, task_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY dag_id, task_id""")
