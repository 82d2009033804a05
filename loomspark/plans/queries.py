"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (or stand-ins Spark derives from them) in full.
Parameters such as thresholds and the ``now`` instant are fixed here so that the
SQL oracles in ``oracles.py`` can state the same computation.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..sources import standins as S

# fixed values: thresholds used by the registered performance queries (FIXTURES.md B)
PERF_THRESHOLDS = {"task_warning_seconds": 50.0, "task_critical_seconds": 55.0,
                   "success_rate_warning": 0.40, "success_rate_critical": 0.36}

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ── run analytics ──────────────────────────────────────────────────────────────

@register("task_performance")
def q_task_performance(spark: SparkSession, sf: str) -> DataFrame:
    return runs.task_performance(S.task_instances(spark, sf), PERF_THRESHOLDS)


@register("health_rollup")
def q_health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    perf = runs.task_performance(S.task_instances(spark, sf), PERF_THRESHOLDS)
    return runs.health_rollup(perf, by=["dag_id"])


@register("run_history")
def q_run_history(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_history(S.dag_runs(spark, sf), n=10)


@register("trend_points")
def q_trend_points(spark: SparkSession, sf: str) -> DataFrame:
    return runs.trend_points(runs.run_history(S.dag_runs(spark, sf), n=10))


@register("jobs_all_dags")
def q_jobs_all_dags(spark: SparkSession, sf: str) -> DataFrame:
    return runs.jobs(S.dag_runs(spark, sf), dag_id=None, limit=20)


@register("jobs_one_dag")
def q_jobs_one_dag(spark: SparkSession, sf: str) -> DataFrame:
    return runs.jobs(S.dag_runs(spark, sf), dag_id="dag_7", limit=20)


@register("latest_run")
def q_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest_run(S.dag_runs(spark, sf))


@register("failed_tasks")
def q_failed_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return runs.failed_tasks(S.task_instances(spark, sf)).select(
        "event_id", "dag_id", "run_id", "task_id", "state", "try_number")


@register("first_failed")
def q_first_failed(spark: SparkSession, sf: str) -> DataFrame:
    return runs.first_failed(S.task_instances(spark, sf), n=5).select(
        "dag_id", "run_id", "task_id", "event_id", "state", "position")


@register("log_error_lines")
def q_log_error_lines(spark: SparkSession, sf: str) -> DataFrame:
    return runs.error_lines(S.task_logs(spark, sf)).select("dag_id", "run_id", "task_id", "line_no", "line")


@register("log_tail")
def q_log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return runs.tail_lines(S.log_lines(spark, sf), n=50)


@register("log_summary")
def q_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return runs.log_summary(S.task_logs(spark, sf), log=["dag_id", "run_id", "task_id"])


# ── reconcile, folder compare, result compare ─────────────────────────────────

from ..operators import compare, linediff, reconcile, windows  # noqa: E402
from ..functions import names as N  # noqa: E402


def _findings(spark, sf, scope="all"):
    return reconcile.reconcile(S.git_files(spark, sf), S.gcs_files(spark, sf), S.mapping(spark, sf),
                               acks=S.acknowledgements(spark, sf), scope=scope)


@register("reconcile")
def q_reconcile(spark, sf):
    return _findings(spark, sf).orderBy("logical_name")


@register("reconcile_summary")
def q_reconcile_summary(spark, sf):
    return reconcile.status_summary(_findings(spark, sf))


@register("reconcile_groups")
def q_reconcile_groups(spark, sf):
    return reconcile.finding_groups(_findings(spark, sf))


@register("reconcile_scope")
def q_reconcile_scope(spark, sf):
    return _findings(spark, sf, scope="git_gcs")


@register("reconcile_filtered")
def q_reconcile_filtered(spark, sf):
    f = reconcile.reconcile(S.git_files(spark, sf), S.gcs_files(spark, sf), S.mapping(spark, sf),
                            acks=S.acknowledgements(spark, sf), folder_filter="DOC_1")
    return reconcile.filter_status(f, "content_drift")


@register("distinct_statuses")
def q_distinct_statuses(spark, sf):
    return reconcile.distinct_statuses(_findings(spark, sf))


@register("normalise_names")
def q_normalise_names(spark, sf):
    d = S.read_table(spark, sf, "documents")
    raw = F.concat(F.lit("sql/"), F.col("source"), F.lit("/"), F.upper("lang"), F.lit("-Doc."),
                   F.col("doc_id").cast("string"), F.lit("_v"), (F.col("doc_id") % 4).cast("string"), F.lit(".sql"))
    return d.select("doc_id", raw.alias("raw_name")).select("doc_id", "raw_name",
                                                            N.normalise_name("raw_name").alias("logical_name"))


@register("safe_table_names")
def q_safe_table_names(spark, sf):
    p = S.read_table(spark, sf, "part")
    return p.select("p_partkey", N.safe_table_name("p_brand", "p_name").alias("table_name"))


def _sizes_as_double(df):
    # nullable integers become float64 on one engine and Int64 on the other; doubles agree
    return (df.withColumn("git_size", F.col("git_size").cast("double"))
            .withColumn("gcs_size", F.col("gcs_size").cast("double"))
            .withColumn("size_delta", F.col("size_delta").cast("double")))


@register("compare_folders")
def q_compare_folders(spark, sf):
    return _sizes_as_double(reconcile.compare_folders(S.git_files(spark, sf), S.gcs_files(spark, sf), folder="sql"))


@register("compare_summary")
def q_compare_summary(spark, sf):
    return reconcile.compare_summary(
        reconcile.compare_folders(S.git_files(spark, sf), S.gcs_files(spark, sf), folder="sql"))


@register("compare_one_file")
def q_compare_one_file(spark, sf):
    return _sizes_as_double(reconcile.compare_folders(S.git_files(spark, sf), S.gcs_files(spark, sf),
                                                      folder="sql/src2", file_name="doc_22.sql"))


@register("folder_line_changes")
def q_folder_line_changes(spark, sf):
    git, gcs = S.git_files(spark, sf), S.gcs_files(spark, sf)
    cmp = reconcile.compare_folders(git, gcs, folder="sql")
    return linediff.change_counts(reconcile.folder_line_changes(git, gcs, cmp, folder="sql"), "rel_path")


@register("folder_diffs")
def q_folder_diffs(spark, sf):
    git, gcs = S.git_files(spark, sf), S.gcs_files(spark, sf)
    cmp = reconcile.compare_folders(git, gcs, folder="sql")
    return reconcile.folder_diffs(git, gcs, cmp, folder="sql")


@register("compare_results")
def q_compare_results(spark, sf):
    return compare.compare_results(S.read_table(spark, sf, "orders"), S.orders_changed(spark, sf))


@register("compare_results_same")
def q_compare_results_same(spark, sf):
    o = S.read_table(spark, sf, "orders")
    return compare.compare_results(o, o.orderBy(F.col("o_totalprice").desc()))


@register("row_diff")
def q_row_diff(spark, sf):
    return compare.row_diff(S.read_table(spark, sf, "orders"), S.orders_changed(spark, sf), n=100)


@register("row_diff_all")
def q_row_diff_all(spark, sf):
    return compare.row_diff(S.read_table(spark, sf, "orders"), S.orders_changed(spark, sf), n=None)


@register("fingerprint")
def q_fingerprint(spark, sf):
    return compare.fingerprint(S.read_table(spark, sf, "orders"))


@register("verdict")
def q_verdict(spark, sf):
    return compare.verdict(compare.compare_results(S.read_table(spark, sf, "orders"), S.orders_changed(spark, sf)))


# ── schema audit ──────────────────────────────────────────────────────────────

from ..operators import audit  # noqa: E402


def _meta(spark, sf):
    return audit.column_metadata(S.schema_header(spark, sf), S.schema_detail(spark, sf))


def _audit(spark, sf):
    a = audit.schema_audit(_meta(spark, sf), S.target_columns(spark, sf))
    # nullable ordinals as double: see _sizes_as_double
    return (a.withColumn("source_ordinal", F.col("source_ordinal").cast("double"))
            .withColumn("target_ordinal", F.col("target_ordinal").cast("double")))


@register("column_metadata")
def q_column_metadata(spark, sf):
    return (_meta(spark, sf).withColumn("deployed_to_prod", F.col("deployed_to_prod").cast("double"))
            .orderBy("table_name", "ordinal_position"))


@register("schema_audit")
def q_schema_audit(spark, sf):
    return audit.audit_order(_audit(spark, sf))


@register("audit_summary")
def q_audit_summary(spark, sf):
    return audit.audit_summary(_audit(spark, sf))


@register("audit_findings")
def q_audit_findings(spark, sf):
    return audit.audit_findings(_audit(spark, sf))


@register("schema_ddl")
def q_schema_ddl(spark, sf):
    return audit.schema_ddl_rows(_meta(spark, sf))


@register("audit_labels")
def q_audit_labels(spark, sf):
    p = S.read_table(spark, sf, "part").select(F.concat(F.col("p_brand"), F.lit(":"), F.col("p_name")).alias("table_name"))
    return audit.short_unique_labels(p, "table_name")


@register("leaf_profile")
def q_leaf_profile(spark, sf):
    return audit.leaf_profile(S.nested_customer(spark, sf))


@register("leaf_profile_nested")
def q_leaf_profile_nested(spark, sf):
    return audit.leaf_profile(S.nested_orders(spark, sf))


# ── delegated SQL (D1–D19) through the read-only entry point ─────────────────

from . import delegated, sqlapi  # noqa: E402


def _delegated_query(tables, sql):
    def q(spark, sf):
        for t in tables:
            S.read_table(spark, sf, t).createOrReplaceTempView(t)
        return sqlapi.run_sql(spark, sql)
    return q


for _name, (_tables, _spark_sql, _duck_sql) in delegated.DELEGATED.items():
    register(_name)(_delegated_query(_tables, _spark_sql))


# ── lineage ───────────────────────────────────────────────────────────────────

from ..operators import graphs, lineage  # noqa: E402


@register("task_graph")
def q_task_graph(spark, sf):
    g = lineage.task_graph(S.task_defs(spark, sf), S.dag_runs(spark, sf), S.graph_instances(spark, sf))
    return g.withColumn("try_number", F.col("try_number").cast("double"))


@register("task_roots")
def q_task_roots(spark, sf):
    return lineage.root_tasks(S.task_defs(spark, sf)).select("dag_id", "task_id", "operator")


@register("child_dag_edges")
def q_child_dag_edges(spark, sf):
    return lineage.child_dag_edges(S.task_defs(spark, sf))


@register("lineage_edges")
def q_lineage_edges(spark, sf):
    return lineage.lineage_edges(S.mapping(spark, sf, every=True), S.task_defs(spark, sf))


@register("sql_coverage")
def q_sql_coverage(spark, sf):
    return lineage.sql_coverage(S.task_defs(spark, sf)).select(
        "dag_id", F.col("tasks").cast("long"), F.col("tasks_with_sql").cast("long"))


@register("task_depth")
def q_task_depth(spark, sf):
    return lineage.task_depth(S.part_tree_edges(spark, sf), S.part_tree_nodes(spark, sf)).select(
        "dag_id", "task_id", F.col("depth").cast("long"))


@register("task_structure")
def q_task_structure(spark, sf):
    return graphs.task_structure(S.part_cycle_edges(spark, sf), S.part_tree_nodes(spark, sf))


@register("lookup_first")
def q_lookup_first(spark, sf):
    return lineage.lookup_first(S.registry(spark, sf), S.trace_needles(spark, sf)).select(
        "needle", F.col("pos").cast("double").alias("pos"), "table_name", "file_path")


@register("mapping_lookup")
def q_mapping_lookup(spark, sf):
    return lineage.mapping_lookup(S.registry(spark, sf), S.mapping_config(spark, sf)).select(
        "pos", "file_path", "bq_table", F.array_join("dag_names", ",").alias("dag_names"))


@register("schema_ddl_arrays")
def q_schema_ddl_arrays(spark, sf):
    return audit.schema_ddl_arrays(audit.schema_ddl_rows(_meta(spark, sf)))


@register("trace")
def q_trace(spark, sf):
    t = lineage.trace(S.trace_needles(spark, sf), S.registry(spark, sf), S.mapping_config(spark, sf),
                      S.dag_runs(spark, sf), S.task_defs(spark, sf), S.graph_instances(spark, sf), n_runs=5)
    return t.withColumn("recency", F.col("recency").cast("double"))


# ── SQL text, JSON, prompts, lint, formats ────────────────────────────────────

from ..functions import sqltext as T  # noqa: E402
from ..functions import timefmt as TF  # noqa: E402
from ..functions import types as TY  # noqa: E402
from ..operators import textjobs  # noqa: E402

FORMAT_NOW = "2024-02-01 00:00:00"


@register("sql_flags")
def q_sql_flags(spark, sf):
    return textjobs.sql_flags(S.sql_statements(spark, sf))


@register("repeated_fragments")
def q_repeated_fragments(spark, sf):
    return textjobs.repeated_fragments(S.sql_statements(spark, sf))


@register("object_access")
def q_object_access(spark, sf):
    return textjobs.object_access(S.sql_statements(spark, sf), group="dag_id")


@register("json_extract")
def q_json_extract(spark, sf):
    r = S.rendered_json(spark, sf).select("event_id", "fields", T.parsed("fields").alias("_v"))
    r = r.select("event_id", "_v", T.extract_sql("fields").alias("sql"),
                 F.get_json_object(T.unwrap_rendered("fields"), "$.configuration").alias("_cfg"),
                 T.is_truncated("fields").alias("truncated"))
    r = r.select("event_id", "_v", "sql", "truncated", T.salvage_truncated_sql("_cfg").alias("salvaged"))
    return r.select(
        "event_id", "sql", T.extract_sql_paths("_v", is_variant=True).alias("sql_fixed_paths"),
        T.sql_file_ref("_v", is_variant=True).alias("sql_file"), "truncated", "salvaged",
        T.best_sql("sql", "salvaged", "truncated").alias("best_sql"))


@register("first_json")
def q_first_json(spark, sf):
    return S.json_texts(spark, sf).select("event_id", textjobs.first_json("text").alias("json"))


@register("json_safe")
def q_json_safe(spark, sf):
    e = S.read_table(spark, sf, "events")
    v = (F.when(F.col("event_id") % 5 == 0, F.lit(float("nan")))
         .when(F.col("event_id") % 7 == 0, F.lit(float("inf")))
         .when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    nested = e.select("event_id", v.alias("v"), F.struct(v.alias("x"), F.array(v, F.col("value")).alias("arr")).alias("s"))
    safe = textjobs.json_safe(nested)
    return safe.select("event_id", "v", F.col("s.x").alias("sx"), F.col("s.arr")[0].alias("a0"),
                       F.col("s.arr")[1].alias("a1"))


@register("expand_glossary")
def q_expand_glossary(spark, sf):
    return textjobs.expand_glossary(S.prompts(spark, sf), S.glossary(spark, sf)).select(
        "conv_id", "turn", "expanded")


@register("prompt_cleanup")
def q_prompt_cleanup(spark, sf):
    p = S.prompts(spark, sf)
    return p.select("conv_id", "turn", T.normalise_whitespace("text").alias("normalised"),
                    textjobs.strip_table_rows("text").alias("stripped"))


@register("lint_sources")
def q_lint_sources(spark, sf):
    return textjobs.lint_sources(S.dag_source_lines(spark, sf))


@register("task_formats")
def q_task_formats(spark, sf):
    ti = S.task_instances(spark, sf)
    return ti.select(
        "event_id", TF.fmt_duration("duration_s").alias("duration_text"),
        N.short_operator("operator").alias("operator_short"), N.job_name("task_id").alias("job_name"),
        TF.fmt_ago("start_date", F.lit(FORMAT_NOW).cast("timestamp_ntz")).alias("age"),
        TF.iso_date("start_date").alias("day"), TF.iso_minute("start_date").alias("minute"),
        TY.confidence_band(F.col("event_id") % 100).alias("band"))


@register("doc_formats")
def q_doc_formats(spark, sf):
    d = S.read_table(spark, sf, "documents")
    ext = F.when(F.col("doc_id") % 9 == 0, F.lit(".bin")).otherwise(F.lit(".sql"))
    hdr = T.split_header_comment(F.concat(F.lit("/* doc "), F.col("doc_id").cast("string"), F.lit(" */\n"), F.col("text")))
    return d.select(
        "doc_id", TF.fmt_size(F.octet_length("text")).alias("size_text"),
        T.line_count("text").cast("long").alias("lines"),
        N.file_language(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)).alias("language"),
        F.array_join(N.split_tags(F.concat(F.col("lang"), F.lit(", "), F.col("source"), F.lit(" ,, "), F.col("lang"))),
                     "|").alias("tags"),
        hdr["header"].alias("header"), F.length(hdr["body"]).cast("long").alias("body_chars"),
        (F.octet_length("text") / 1e6).alias("megabytes"))


# ── catalog, listings, stores ─────────────────────────────────────────────────

from ..operators import catalog, stores  # noqa: E402
from ..sources.tables import TABLE_NAMES  # noqa: E402


@register("stringify_all")
def q_stringify_all(spark, sf):
    return catalog.stringify_all(S.nested_customer(spark, sf))


@register("table_stats")
def q_table_stats(spark, sf):
    return catalog.table_stats(spark, {t: S.read_table(spark, sf, t) for t in TABLE_NAMES}).select(
        "table_name", "row_count", "column_count")


@register("list_dags")
def q_list_dags(spark, sf):
    return catalog.list_dags(S.dags(spark, sf), tag="team_1", subfolder_filter="SALES")


@register("list_dags_all")
def q_list_dags_all(spark, sf):
    return catalog.list_dags(S.dags(spark, sf))


@register("list_loaded")
def q_list_loaded(spark, sf):
    reg = S.registry(spark, sf)
    active = reg.where(F.col("pos") % 4 != 0).select("table_name")
    return catalog.list_loaded(reg, active, folder_filter="MAP").select("pos", "table_name", "source_folder", "file_path")


@register("target_of")
def q_target_of(spark, sf):
    t = catalog.target_of(S.registry(spark, sf), S.mapping_config(spark, sf), S.trace_needles(spark, sf))
    return t.select("needle", "bq_table", F.array_join("dag_names", ",").alias("dag_names"))


@register("folder_listing")
def q_folder_listing(spark, sf):
    pages = S.read_table(spark, sf, "pages")
    objs = catalog.object_paths(pages.withColumn("bytes", F.octet_length("html")), "url", size="bytes")
    return catalog.folder_listing(objs, prefix="")


@register("folder_listing_en")
def q_folder_listing_en(spark, sf):
    pages = S.read_table(spark, sf, "pages")
    objs = catalog.object_paths(pages.withColumn("bytes", F.octet_length("html")), "url", size="bytes")
    return catalog.folder_listing(objs, prefix="en/")


@register("split_uri")
def q_split_uri(spark, sf):
    p = S.read_table(spark, sf, "pages")
    u = N.split_object_uri("url")
    return p.select("page_id", u["bucket"].alias("bucket"), u["prefix"].alias("prefix"),
                    N.subfolder("url").alias("subfolder"))


@register("upsert")
def q_upsert(spark, sf):
    d = S.read_table(spark, sf, "documents")
    store = d.where((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 != 0)).select("doc_id", "source", F.lit(1).alias("version"))
    new = d.where(F.col("doc_id") % 3 == 0).select("doc_id", F.upper("source").alias("source"), F.lit(2).alias("version"))
    return stores.upsert(store, new, ["doc_id"], "version")


@register("last_wins")
def q_last_wins(spark, sf):
    d = S.read_table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    return stores.last_wins(d, ["source"], "doc_id")


@register("cap_history")
def q_cap_history(spark, sf):
    p = S.prompts(spark, sf).select("conv_id", "turn", "role")
    return stores.cap_history(p, 500, order=["conv_id", "turn"])


@register("search_queries")
def q_search_queries(spark, sf):
    return stores.search_queries(S.saved_queries(spark, sf), text="Turn 2", source="assistant").select(
        "id", "name", "source", "description")


@register("search_tags")
def q_search_tags(spark, sf):
    return stores.search_queries(S.saved_queries(spark, sf), text="ang_1").select("id", "name", "source")


@register("search_glossary")
def q_search_glossary(spark, sf):
    return stores.search_glossary(S.glossary(spark, sf), "th")


# ── windowed health (the batch form of the streaming job) ─────────────────────

from ..streaming.health import health_windows  # noqa: E402


@register("health_windows")
def q_health_windows(spark, sf):
    return health_windows(S.task_instances(spark, sf), "1 day", PERF_THRESHOLDS)


# ── composites and set operations ─────────────────────────────────────────────

@register("latest_task_sql")
def q_latest_task_sql(spark, sf):
    return lineage.latest_task_sql(S.dag_runs(spark, sf), S.rendered_instances(spark, sf), 10)


@register("task_sql")
def q_task_sql(spark, sf):
    return lineage.task_sql(S.task_defs(spark, sf), S.dag_runs(spark, sf), S.rendered_instances(spark, sf), 10)


@register("task_sql_files")
def q_task_sql_files(spark, sf):
    return lineage.task_sql(S.load_tasks(spark, sf), S.dag_runs(spark, sf), S.load_instances(spark, sf), 10,
                            files=S.load_files(spark, sf))


def _trace_inputs(spark, sf):
    return S.trace_needles(spark, sf), S.registry(spark, sf), S.mapping_config(spark, sf), S.dag_runs(spark, sf)


@register("trace_runs")
def q_trace_runs(spark, sf):
    t = lineage.trace_runs(*_trace_inputs(spark, sf), n_runs=5)
    return t.withColumn("recency", F.col("recency").cast("long"))


@register("trace_tasks")
def q_trace_tasks(spark, sf):
    return lineage.trace_tasks(*_trace_inputs(spark, sf), S.task_defs(spark, sf), S.graph_instances(spark, sf))


@register("trace_sql")
def q_trace_sql(spark, sf):
    return lineage.trace_sql(*_trace_inputs(spark, sf), S.task_defs(spark, sf), S.rendered_instances(spark, sf))


@register("lineage_nodes")
def q_lineage_nodes(spark, sf):
    return lineage.lineage_nodes(S.mapping(spark, sf, every=True), S.task_defs(spark, sf))


@register("error_report")
def q_error_report(spark, sf):
    return runs.error_report(S.task_instances(spark, sf), S.task_logs(spark, sf)).withColumn(
        "position", F.col("position").cast("long"))


@register("execution_log_runs")
def q_execution_log_runs(spark, sf):
    return runs.run_history(S.dag_runs(spark, sf), n=20)


@register("reconcile_detail")
def q_reconcile_detail(spark, sf):
    f = _findings(spark, sf).where(F.col("status") == "content_drift").select("logical_name")
    return reconcile.reconcile_detail(S.git_files(spark, sf), S.gcs_files(spark, sf), S.mapping(spark, sf), f)


@register("reconcile_overrides")
def q_reconcile_overrides(spark, sf):
    # explicit raw → logical names: every gcs name ending in _v3 is declared under "<name>_legacy"
    ov = S.gcs_files(spark, sf).where(F.col("raw_name").like("%\\_v3.sql")).select(
        "raw_name", F.concat(N.normalise_name("raw_name"), F.lit("_legacy")).alias("logical_name"))
    return reconcile.reconcile(S.git_files(spark, sf), S.gcs_files(spark, sf), S.mapping(spark, sf),
                               acks=S.acknowledgements(spark, sf), overrides=ov)


def _rel(df):
    return df.select(F.substring("path", 5, 1 << 30).alias("rel_path"))


@register("only_in_git")
def q_only_in_git(spark, sf):
    return _rel(S.git_files(spark, sf)).join(_rel(S.gcs_files(spark, sf)), "rel_path", "left_anti")


@register("common_files")
def q_common_files(spark, sf):
    return _rel(S.git_files(spark, sf)).join(_rel(S.gcs_files(spark, sf)), "rel_path", "left_semi")


@register("name_universe")
def q_name_universe(spark, sf):
    names = [reconcile.with_logical_name(d).select("logical_name")
             for d in (S.git_files(spark, sf), S.gcs_files(spark, sf), S.mapping(spark, sf))]
    return names[0].union(names[1]).union(names[2]).distinct()


@register("preview")
def q_preview(spark, sf):
    return S.read_table(spark, sf, "orders").orderBy("o_orderkey").limit(500)


@register("flag_counts")
def q_flag_counts(spark, sf):
    f = textjobs.sql_flags(S.sql_statements(spark, sf))
    return f.groupBy("flag_type").agg(F.count(F.lit(1)).alias("n"),
                                      F.count_if(F.col("severity") == "high").cast("long").alias("high_impact"))


from ..operators.asof import asof_join  # noqa: E402


@register("asof_orders")
def q_asof_orders(spark, sf):
    """D5 with the skew-safe as-of operator: for each event (shifted 25 years back), the
    customer's latest order at or before it."""
    e = S.read_table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 25 YEARS")).alias("ets"))
    o = S.read_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    o = o.withColumnRenamed("o_custkey", "user_id")
    j = asof_join(e, o, "user_id", "ets", "o_orderdate", ["o_orderkey"], right_order="o_orderkey")
    return j.select("event_id", "user_id", F.col("o_orderkey").cast("double").alias("o_orderkey"))


@register("windows_orders")
def q_windows_orders(spark, sf):
    """D8 with the skew-safe windows: the columns of ``sql_d8_windows`` by halo blocks."""
    o = S.read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        (-F.col("o_totalprice")).alias("down"))
    o = windows.ordered_windows(o, ["o_custkey"], ["down", "o_orderkey"], number="price_rank")
    o = windows.ordered_windows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], number="n", running={"running_total": "price"},
                                shifted={"prev_order": ("o_orderkey", 1), "next_order": ("o_orderkey", -1)})
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "price_rank", F.col("prev_order").cast("double").alias("prev_order"),
                    F.col("next_order").cast("double").alias("next_order"), F.least("n", F.lit(3)).cast("long").alias("last3"),
                    F.col("running_total").cast("double").alias("running_total"))


@register("task_performance_recent")
def q_task_performance_recent(spark, sf):
    """Per task over each DAG's newest 10 runs (runs are the distinct run days seen in
    the task instances)."""
    ti = S.task_instances(spark, sf)
    ti_runs = ti.groupBy("dag_id", "run_id").agg(F.min("start_date").cast("date").alias("logical_date")) \
        .withColumn("run_key", F.lit(0))
    return runs.task_performance(ti, PERF_THRESHOLDS, runs=ti_runs, last_runs=10)


@register("task_depth_recursive")
def q_task_depth_recursive(spark, sf):
    t = S.task_defs(spark, sf)
    nodes = t.select("dag_id", "task_id")
    return lineage.task_depth_recursive(lineage.task_edges(t), nodes)


@register("dags_of")
def q_dags_of(spark, sf):
    return catalog.dags_of(S.registry(spark, sf), S.mapping_config(spark, sf), S.trace_needles(spark, sf))


@register("task_table")
def q_task_table(spark, sf):
    return catalog.project_task_table(
        lineage.task_graph(S.task_defs(spark, sf), S.dag_runs(spark, sf), S.graph_instances(spark, sf)))


@register("ago_text")
def q_ago_text(spark, sf):
    e = S.read_table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("not a time "), F.col("event_id").cast("string")))
            .when(F.col("event_id") % 4 == 1, F.lit("")).when(F.col("event_id") % 4 == 2, F.concat(iso, F.lit("Z")))
            .otherwise(iso))
    return e.select("event_id", TF.fmt_ago_text(text, F.lit(FORMAT_NOW).cast("timestamp")).alias("age"))
