"""Stand-in inputs derived from the driver's tables.

The operators consume shapes such as task instances, DAG runs, file inventories and
column metadata.  These builders derive those shapes from the driver's tables with
plain column expressions, so every job's work grows with the tables.  The rules
(which key goes to which DAG, which document is in which inventory) are fixed
values shared with the SQL oracles; see FIXTURES.md part B.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .tables import read_table


def _secs(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def task_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → task instances: one event is one task try."""
    e = read_table(spark, sf_dir, "events")
    state = (F.when(F.col("event_type") == "error", "failed")
             .when(F.col("event_type") == "signup", "upstream_failed")
             .when(F.col("event_type") == "view", "running")
             .otherwise("success"))
    duration = F.when(F.col("event_type") == "view", F.lit(None).cast("double")).otherwise(F.col("value"))
    # fixed values: operator class per event type
    operator = (F.when(F.col("event_type") == "purchase", "BigQueryInsertJobOperator")
                .when(F.col("event_type") == "click", "PythonOperator")
                .when(F.col("event_type") == "error", "BashOperator")
                .when(F.col("event_type") == "signup", "TriggerDagRunOperator")
                .otherwise("EmptyOperator"))
    return e.select(
        F.col("event_id"),
        F.concat(F.lit("dag_"), (F.col("user_id") % 5).cast("string")).alias("dag_id"),
        F.concat(F.lit("task_"), (F.col("user_id") % 7).cast("string")).alias("task_id"),
        F.concat(F.lit("run_"), F.col("ts").cast("date").cast("string")).alias("run_id"),
        state.alias("state"),
        duration.alias("duration_s"),
        F.col("ts").alias("start_date"),
        (F.col("ts") + _secs(duration)).alias("end_date"),
        (F.lit(1) + F.col("event_id") % 3).cast("int").alias("try_number"),
        operator.alias("operator"),
        F.col("props").alias("rendered_fields"),
    )


def dag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → DAG runs."""
    o = read_table(spark, sf_dir, "orders")
    start = F.timestamp_add("SECOND", F.col("o_orderkey") % 3600, F.col("o_orderdate"))
    end = F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(
        F.timestamp_add("SECOND", F.col("o_orderkey") % 3600 + F.col("o_orderkey") % 977, F.col("o_orderdate")))
    state = (F.when(F.col("o_orderstatus") == "F", "success")
             .when(F.col("o_orderstatus") == "P", "failed")
             .otherwise("running"))
    return o.select(
        F.concat(F.lit("dag_"), (F.col("o_custkey") % 20).cast("string")).alias("dag_id"),
        F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderkey").alias("run_key"),
        F.col("o_orderdate").alias("logical_date"),
        start.alias("start_date"),
        end.alias("end_date"),
        state.alias("state"),
        F.col("o_orderpriority").alias("run_type"),
    )


def _doc_path():
    ext = F.when(F.col("doc_id") % 9 == 0, F.lit(".bin")).otherwise(F.lit(".sql"))
    return F.concat(F.lit("sql/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), ext)


def git_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").where((F.col("doc_id") % 10 != 0) | (F.col("doc_id") % 70 == 0))
    return d.select(
        F.regexp_extract(_doc_path(), r"([^/]*)$", 1).alias("raw_name"),
        _doc_path().alias("path"),
        F.col("doc_id").alias("seq"),
        F.col("text").alias("content"),
    )


def gcs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").where(F.col("doc_id") % 7 != 0)
    content = F.when(F.col("doc_id") % 11 == 0, F.concat(F.col("text"), F.lit(" drift"))).otherwise(F.col("text"))
    return d.select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"), F.lit("_v"),
                 (F.col("doc_id") % 3 + 1).cast("string"), F.lit(".sql")).alias("raw_name"),
        _doc_path().alias("path"),
        F.col("doc_id").alias("seq"),
        content.alias("content"),
    )


def mapping(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """The mapping inventory: without a third of the documents where it is held against other inventories, or of
    ``every`` document."""
    d = read_table(spark, sf_dir, "documents")
    if not every:
        d = d.where(F.col("doc_id") % 3 != 0)
    bq = F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(
        F.concat(F.lit("p.d.t"), F.col("doc_id").cast("string")))
    return d.select(
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("raw_name"),
        F.col("doc_id").alias("seq"),
        bq.alias("bq_table"),
        F.array(F.concat(F.lit("dag_"), (F.col("doc_id") % 20).cast("string"))).alias("dag_names"),
    )


# fixed values: source type by p_type prefix, target type family by key
_SOURCE_TYPE = [("ECONOMY", "int"), ("LARGE", "VARCHAR "), ("MEDIUM", "decimal"),
                ("PROMO", "datetime"), ("SMALL", "bit")]
_TARGET_TYPE = [("ECONOMY", "INTEGER"), ("LARGE", "STRING"), ("MEDIUM", "BIGNUMERIC"),
                ("PROMO", "DATETIME"), ("SMALL", "BOOLEAN")]


def _by_type(pairs, other):
    expr = None
    for prefix, val in pairs:
        cond = F.col("p_type").startswith(prefix)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(other)


def source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part → source (MySQL-like) column metadata: header ⋈ detail shape flattened."""
    p = read_table(spark, sf_dir, "part").where((F.col("p_partkey") % 17 != 0) | (F.col("p_partkey") % 85 == 0))
    return p.select(
        F.concat(F.lit("tbl_"), F.col("p_size").cast("string")).alias("table_name"),
        F.concat(F.lit("col_"), F.col("p_partkey").cast("string")).alias("column_name"),
        F.col("p_partkey").alias("ordinal_position"),
        _by_type(_SOURCE_TYPE, "geometry").alias("data_type"),
        F.when(F.col("p_size") % 2 == 0, F.lit(1)).when(F.col("p_size") % 5 == 0, F.lit(None))
        .otherwise(F.lit(0)).cast("int").alias("deployed_to_prod"),
        F.when(F.col("p_size") % 10 == 3, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("is_streamed"),
    )


def target_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part → target (warehouse) columns."""
    p = read_table(spark, sf_dir, "part").where(F.col("p_partkey") % 5 != 0)
    typ = F.when(F.col("p_partkey") % 9 == 0, F.lit("BYTES")).otherwise(_by_type(_TARGET_TYPE, "GEOMETRY"))
    return p.select(
        F.concat(F.lit("tbl_"), F.col("p_size").cast("string")).alias("table_name"),
        F.concat(F.lit("col_"), F.col("p_partkey").cast("string")).alias("column_name"),
        F.col("p_partkey").alias("ordinal_position"),
        typ.alias("data_type"),
        F.col("p_name").alias("description"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → task logs split into numbered lines (line_no is 1-based)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("log_id"),
        F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"),
    ).select("log_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", "text")


def string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with every column as string (the all-string workbook shape)."""
    c = read_table(spark, sf_dir, "customer")
    return c.select([F.col(x).cast("string").alias(x) for x in c.columns])


def task_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → one log line per event in the log of its (dag, run, task); the level word
    follows the event type, so failed tries carry ERROR lines."""
    ti = task_instances(spark, sf_dir)
    level = (F.when(F.col("state") == "failed", "ERROR")
             .when(F.col("state") == "upstream_failed", "WARNING").otherwise("INFO"))
    line = F.concat_ws(" ", F.date_format("start_date", "yyyy-MM-dd HH:mm:ss"), level,
                       F.col("task_id"), F.col("operator"),
                       F.concat(F.lit("duration="), F.coalesce(F.col("duration_s").cast("string"), F.lit("none"))))
    return ti.select("dag_id", "run_id", "task_id", "try_number", F.col("event_id").alias("line_no"),
                     line.alias("line"))


def acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").where(F.col("doc_id") % 8 == 1)
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("logical_name"),
                    F.lit("known").alias("reason"))


def orders_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a rewritten query might return them: some rows missing, some prices
    changed, some rows doubled."""
    o = read_table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = o.where(F.col("o_orderkey") % 89 != 0).withColumn("o_totalprice", price)
    return kept.unionByName(o.where(F.col("o_orderkey") % 83 == 0))


def schema_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header row per source table (tables are part sizes)."""
    sc = source_columns(spark, sf_dir)
    return sc.select("table_name", "deployed_to_prod", "is_streamed").dropDuplicates(["table_name"])


def schema_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_columns(spark, sf_dir).select("table_name", "column_name", "ordinal_position", "data_type")


def nested_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with nested structs and an array, for the leaf-path profile."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.struct(F.col("c_name").alias("name"),
                 F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("geo")
                 ).alias("profile"),
        F.struct(F.col("c_acctbal").alias("balance")).alias("account"),
        F.when(F.col("c_acctbal") > 0, F.array(F.col("c_mktsegment"))).alias("tags"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array of structs inside a struct, and names that need quoting."""
    item = F.struct(F.col("l_partkey").alias("part"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("off.rate"),
                    F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag's")).alias("back"),
                    F.when(F.col("l_quantity") > 25, F.array(F.col("l_quantity"))).alias("lots"))
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    o = read_table(spark, sf_dir, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("paid.total"),
        F.struct(F.col("items"), F.array(F.col("items")).alias("groups")).alias("content"))


# fixed values: the task template every DAG runs (line number → task)
TASK_TEMPLATE = [
    # (n, operator, downstream line numbers)
    (1, "EmptyOperator", [2, 3]),
    (2, "BigQueryInsertJobOperator", [4]),
    (3, "PythonOperator", [4, 5]),
    (4, "BigQueryInsertJobOperator", [6]),
    (5, "TriggerDagRunOperator", [7]),
    (6, "BashOperator", [7]),
    (7, "BigQueryInsertJobOperator", []),
]


def task_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task definitions: every DAG seen in the runs gets the 7-task template; BigQuery tasks
    carry SQL text, the trigger task names the next DAG."""
    dags = dag_runs(spark, sf_dir).select("dag_id").distinct()
    n = F.col("n")
    op = F.element_at(F.array(*[F.lit(o) for _, o, _ in TASK_TEMPLATE]), n)
    down = F.element_at(F.array(*[F.array(*[F.lit(f"line_{d}") for d in ds]).cast("array<string>")
                                  for _, _, ds in TASK_TEMPLATE]), n)
    dag_no = F.regexp_extract("dag_id", r"([0-9]+)$", 1).cast("int")
    is_bq = op.startswith("BigQuery")
    sql = F.when(is_bq, F.concat(
        F.lit("SELECT * FROM ds.t_"), dag_no.cast("string"), F.lit("_"), n.cast("string"),
        F.when(n == 4, F.concat(F.lit(" WHERE DATE(load_ts) = CURRENT_DATE() AND k IN (SELECT k FROM ds.t_"),
                                dag_no.cast("string"), F.lit("_2)"))).otherwise(F.lit(""))))
    return (dags.select("dag_id", F.explode(F.sequence(F.lit(1), F.lit(len(TASK_TEMPLATE)))).alias("n"))
            .select("dag_id", F.concat(F.lit("line_"), n.cast("string")).alias("task_id"),
                    op.alias("operator"), down.alias("downstream_task_ids"),
                    F.when(op.contains("TriggerDagRun"),
                           F.concat(F.lit("dag_"), ((dag_no + 1) % 20).cast("string"))).alias("trigger_dag_id"),
                    sql.alias("sql")))


def graph_instances(spark: SparkSession, sf_dir: str, *of_run: str) -> DataFrame:
    """lineitem → task instances: line n of order k is task line_n of run run_k; with the columns ``of_run`` of the run."""
    li = read_table(spark, sf_dir, "lineitem")
    runs = dag_runs(spark, sf_dir).select("dag_id", "run_id", "run_key", *of_run)
    state = (F.when(F.col("l_returnflag") == "R", "failed")
             .when(F.col("l_linestatus") == "F", "success").otherwise("running"))
    start = F.col("l_shipdate")
    end = F.timestamp_add("SECOND", (F.col("l_quantity") * 60).cast("long"), F.col("l_shipdate"))
    inst = li.select(
        F.col("l_orderkey").alias("run_key"),
        F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("task_id"),
        state.alias("state"), start.alias("start_date"),
        F.when(F.col("l_linestatus") == "F", end).alias("end_date"),
        (F.col("l_quantity") * 60).alias("duration"),
        F.lit(1).alias("try_number"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"))
    return inst.join(runs, "run_key").drop("run_key")


def part_tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger task graph from part: DAG = key mod 20, node i of a DAG points at 2i+1 and
    2i+2 of the same DAG; SMALL parts are sinks."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    k = F.col("p_partkey")
    dag, i = k % 20, F.floor(k / 20)
    kids = F.array((2 * i + 1) * 20 + dag, (2 * i + 2) * 20 + dag)
    e = (p.where(~F.col("p_type").startswith("SMALL"))
         .select(F.concat(F.lit("dag_"), dag.cast("string")).alias("dag_id"),
                 F.concat(F.lit("t"), k.cast("string")).alias("src"),
                 F.explode(kids).alias("child")))
    keys = p.select(F.col("p_partkey").alias("child"))
    return (e.join(keys, "child", "left_semi")
            .select("dag_id", "src", F.concat(F.lit("t"), F.col("child").cast("string")).alias("dst")))


def part_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    return p.select(F.concat(F.lit("dag_"), (F.col("p_partkey") % 20).cast("string")).alias("dag_id"),
                    F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("task_id"))


def part_cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task graph of ``part_tree_edges`` with edges back to the parent (keys divisible by 7), to the
    grandparent (by 11) and to the task itself (by 31)."""
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    dag, i = k % 20, F.floor(k / 20)
    up = lambda n: F.floor((n - 1) / 2)
    back = F.array(F.when((k % 7 == 0) & (i >= 1), up(i)), F.when((k % 11 == 0) & (i >= 3), up(up(i))), F.when(k % 31 == 0, i))
    e = p.select(F.concat(F.lit("dag_"), dag.cast("string")).alias("dag_id"), F.concat(F.lit("t"), k.cast("string")).alias("src"),
                 F.explode(F.filter(back, lambda x: x.isNotNull())).alias("to"), dag.alias("dag"))
    e = e.withColumn("to", F.col("to") * 20 + F.col("dag")).join(p.select(F.col("p_partkey").alias("to")), "to", "left_semi")
    return part_tree_edges(spark, sf_dir).unionByName(
        e.select("dag_id", "src", F.concat(F.lit("t"), F.col("to").cast("string")).alias("dst")))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook registry: one workbook per part, insertion order = part key."""
    p = read_table(spark, sf_dir, "part")
    folder = F.when(F.col("p_partkey") % 2 == 0, F.lit("mapping")).otherwise(F.lit("master"))
    stem = F.concat(F.regexp_replace("p_brand", "#", "_"), F.lit(" "), F.col("p_name"))
    return p.select(
        F.col("p_partkey").alias("pos"),
        folder.alias("source_folder"),
        F.lower(F.regexp_replace(F.concat(folder, F.lit("_"), stem), "[^A-Za-z0-9_]+", "_")).alias("table_name"),
        F.concat(F.lit("/data/"), folder, F.lit("/"), stem, F.lit(".xlsx")).alias("file_path"),
        stem.alias("stem"))


def mapping_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem → (bq_table, dag_names); odd keys are stored lower-cased (exercises the
    lower-case fallback); duplicate stems: the last (largest key) wins."""
    p = read_table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 != 0)
    stem = F.concat(F.regexp_replace("p_brand", "#", "_"), F.lit(" "), F.col("p_name"))
    key = F.when(F.col("p_partkey") % 2 == 0, stem).otherwise(F.lower(stem))
    bq = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("ds.t"), F.col("p_partkey").cast("string")))
    rows = p.select(key.alias("stem"), F.col("p_partkey").alias("seq"), bq.alias("bq_table"),
                    F.array(F.concat(F.lit("dag_"), (F.col("p_partkey") % 20).cast("string"))).alias("dag_names"))
    return (rows.groupBy("stem").agg(F.max_by(F.struct("bq_table", "dag_names"), "seq").alias("m"))
            .select("stem", "m.bq_table", "m.dag_names"))


def trace_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names a user may trace: every part-name word and every nation name."""
    p = read_table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("needle"))
    n = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("needle"))
    return p.unionByName(n).distinct()


def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → one SQL statement per order, in six shapes (select *, UDF in WHERE,
    insert-select, repeated subquery, merge with comment, CTE with functions)."""
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shape = F.col("o_orderkey") % 6
    sql = (F.when(shape == 0, F.concat(F.lit("SELECT * FROM sales.orders_"), c))
           .when(shape == 1, F.concat(F.lit("SELECT o_id, price FROM sales.orders_v WHERE UDF_CLEAN(o_id) = "), k))
           .when(shape == 2, F.concat(F.lit("INSERT INTO mart.daily_"), (F.col("o_custkey") % 7).cast("string"),
                                      F.lit(" SELECT count(*) FROM sales.orders_"), c,
                                      F.lit(" WHERE o_date = DATE '"), day, F.lit("'")))
           .when(shape == 3, F.concat(F.lit("SELECT a FROM t WHERE a IN (SELECT k FROM ref.keys_"),
                                      (F.col("o_custkey") % 3).cast("string"),
                                      F.lit(") OR b IN (SELECT k FROM ref.keys_"),
                                      (F.col("o_custkey") % 3).cast("string"), F.lit(")")))
           .when(shape == 4, F.concat(F.lit("/* header */ MERGE INTO mart.cust_"), c,
                                      F.lit(" USING stage.c ON TRUE -- SELECT * FROM x")))
           .otherwise(F.concat(F.lit("WITH x AS (SELECT o.* FROM ops.orders o JOIN ops.lines l ON l.k = o.k) "
                                     "SELECT x.k FROM x WHERE lower(x.s) = 'f' AND my_fn(x.p) > "), k)))
    return o.select(F.col("o_orderkey").alias("stmt_id"),
                    F.concat(F.lit("dag_"), (F.col("o_custkey") % 20).cast("string")).alias("dag_id"),
                    sql.alias("sql"))


def rendered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → rendered task fields as JSON text in five layouts (nested BigQuery job,
    top-level sql, SQL deep in another key, truncated repr, .sql file reference)."""
    e = read_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    kk = F.get_json_object("props", "$.k")
    t = F.col("event_type")
    js = (F.when(t == "purchase", F.concat(
              F.lit('{"configuration": {"query": {"query": "SELECT amount FROM sales WHERE user_id = '), uid,
              F.lit('", "useLegacySql": false}}}')))
          .when(t == "click", F.concat(F.lit('{"sql": "  SELECT * FROM clicks WHERE k = '), kk,
                                       F.lit('  ", "bql": "x"}')))
          .when(t == "error", F.concat(F.lit('{"bash_command": "exit 1", "env": {"Q": "WITH x AS (SELECT '), eid,
                                       F.lit(') SELECT * FROM x"}}')))
          .when(t == "signup", F.concat(
              F.lit('{"rendered_fields": {"configuration": "Truncated. You can change this behaviour. '
                    "{'query': {'query': 'SELECT id FROM users WHERE signup_id = "), eid,
              F.lit("', 'useLegacySql': False}}...\"}}")))
          .otherwise(F.concat(F.lit('{"query": "short", "params": ["INSERT INTO t VALUES ('), eid,
                              F.lit(', 1, 2, 3)"], "sql": "load/users_'), uid, F.lit('.sql"}'))))
    return e.select("event_id", js.alias("fields"))


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark → glossary: every word of ten letters or more is a term (its first place over
    all passages fixes its position, the last passage with it gives its definition)."""
    b = read_table(spark, sf_dir, "benchmark")
    rows = b.select("item_id", F.posexplode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("i", "term")).select(
        "term", "item_id", (F.col("item_id") * 100_000 + F.col("i")).alias("at"),
        F.concat(F.lit("passage "), F.col("item_id").cast("string")).alias("definition"))
    return (rows.where(F.length("term") >= 10).groupBy("term")
            .agg(F.min("at").alias("pos"), F.max_by("definition", "item_id").alias("definition")))


def dag_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → one Airflow DAG source file per order, as numbered lines."""
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ks = k.cast("string")
    lines = F.array(
        F.lit("from airflow import DAG"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("from airflow.operators.bash_operator import BashOperator"))
        .otherwise(F.lit("from airflow.operators.bash import BashOperator")),
        F.lit("from airflow.models import Variable"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("TARGET = Variable.get('target_"), c, F.lit("')")))
        .otherwise(F.concat(F.lit("TARGET = 'ds_"), c, F.lit("'"))),
        F.concat(F.lit("with DAG('dag_"), ks, F.lit("', start_date="),
                 F.when(k % 4 == 0, F.lit("datetime.now()")).otherwise(F.lit("datetime(2024, 1, 1)")),
                 F.lit(", schedule_interval='@daily'"),
                 F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(", catchup=False")),
                 F.when(k % 6 == 0, F.lit("")).otherwise(F.lit(", default_args={'retries': 2}")),
                 F.lit(") as dag:")),
        F.concat(F.lit("    start = "), F.when(k % 2 == 0, F.lit("DummyOperator")).otherwise(F.lit("EmptyOperator")),
                 F.lit("(task_id='start')")),
        F.concat(F.lit("    load = BashOperator(task_id='load', bash_command='run.sh {{ "),
                 F.when(F.col("o_orderstatus") == "F", F.lit("execution_date")).otherwise(F.lit("logical_date")),
                 F.lit(" }}')")),
        F.when(k % 7 == 0, F.lit("    start.set_downstream(load)")).otherwise(F.lit("    start >> load")),
        F.when(k % 3 == 0, F.concat(F.lit("    dag.doc_md = 'Loads order "), ks, F.lit("'"))).otherwise(F.lit("")))
    return o.select(F.concat(F.lit("dags/dag_"), ks, F.lit(".py")).alias("path"),
                    F.posexplode(lines).alias("pos", "line")).select(
        "path", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → assistant-style texts around the props JSON: fenced, inline, or array."""
    e = read_table(spark, sf_dir, "events")
    m = F.col("event_id") % 4
    t = (F.when(m == 0, F.concat(F.lit("Result:\n```json\n"), F.col("props"), F.lit("\n```\nDone.")))
         .when(m == 1, F.concat(F.lit("The answer is "), F.col("props"), F.lit(" as requested {not json}")))
         .when(m == 2, F.concat(F.lit("List: ["), F.col("props"), F.lit(", {\"s\": \"a]b\"}] end")))
         .otherwise(F.concat(F.lit("no json here, value "), F.col("value").cast("string"))))
    return e.select("event_id", t.alias("text"))


def dags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → one DAG per order: schedule by priority, paused when status P, tags
    (team, priority) and a file location (some at the root of the DAG folder)."""
    o = read_table(spark, sf_dir, "orders")
    ks = F.col("o_orderkey").cast("string")
    sched = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("@hourly"))
             .when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.lit("@daily")))
    tags = F.array(F.struct(F.concat(F.lit("team_"), (F.col("o_custkey") % 3).cast("string")).alias("name")),
                   F.struct(F.concat(F.lit("prio_"), F.substring("o_orderpriority", 1, 1)).alias("name")))
    loc = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("dag_"), ks, F.lit(".py"))).otherwise(
        F.concat(F.lit("/home/airflow/gcs/dags/"), F.lower("o_orderstatus"), F.lit("/sales/dag_"), ks, F.lit(".py")))
    return o.select(F.concat(F.lit("dag_"), ks).alias("dag_id"), sched.alias("schedule_interval"),
                    (F.col("o_orderstatus") == "P").alias("is_paused"), tags.alias("tags"), loc.alias("file_loc"))


def saved_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations → saved queries (one per turn)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.concat(F.lit("q_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("name"),
        F.col("text").alias("sql"), F.col("role").alias("source"),
        F.when(F.col("turn") % 3 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.col("role"), F.lit(" turn "), F.col("turn").cast("string"))).alias("description"),
        F.array(F.concat(F.lit("Lang_"), (F.col("conv_id") % 4).cast("string")),
                F.concat(F.lit("T"), F.col("turn").cast("string"))).alias("tags"))


def rendered_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_instances with the SQL each finished BigQuery task rendered for its run
    (the template with the run's logical date in place of CURRENT_DATE())."""
    inst = graph_instances(spark, sf_dir, "logical_date")
    defs = stored(task_defs(spark, sf_dir).select("dag_id", "task_id", "sql"))  # a few rows a DAG: known as such once written
    day = F.concat(F.lit("DATE '"), F.date_format("logical_date", "yyyy-MM-dd"), F.lit("'"))
    rendered = F.when(F.col("sql").isNotNull() & (F.col("state") == "success"),
                      F.replace(F.col("sql"), F.lit("CURRENT_DATE()"), day))
    return (inst.join(defs, ["dag_id", "task_id"])
            .select("dag_id", "run_id", "task_id", "state", "seq", rendered.alias("rendered_sql")))


def load_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → one loading task per order, its definition as JSON text: a .sql file reference, SQL at the
    top, a nested query job, or none (by key mod 4)."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    shape = F.col("o_orderkey") % 4
    js = (F.when(shape == 0, F.concat(F.lit('{"sql": "sql/load_'), k, F.lit('.sql"}')))
          .when(shape == 1, F.concat(F.lit('{"retries": 2, "sql": "SELECT a, b FROM ds.top_'), k, F.lit('"}')))
          .when(shape == 2, F.concat(F.lit('{"configuration": {"query": {"query": "SELECT c FROM ds.job_'), k, F.lit('"}}}')))
          .otherwise(F.lit('{"python_callable": "run"}')))
    return o.select(F.concat(F.lit("dag_"), (F.col("o_custkey") % 20).cast("string")).alias("dag_id"),
                    F.concat(F.lit("load_"), k).alias("task_id"), js.alias("definition"))


def load_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → the .sql files that half of the references of ``load_tasks`` find, some below two roots."""
    o = read_table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0")
    k = F.col("o_orderkey").cast("string")
    roots = F.when(F.col("o_orderkey") % 16 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    return o.select(F.concat(F.lit("sql/load_"), k, F.lit(".sql")).alias("rel_path"), k.alias("k"),
                    F.explode(roots).alias("root_order")).select(
        "rel_path", "root_order", F.concat(F.lit("SELECT file_col FROM root"), F.col("root_order").cast("string"),
                                           F.lit(".t_"), F.col("k")).alias("content"))


def load_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → the instance of each loading task in its run, with rendered fields: a truncated repr, plain
    SQL, or nothing (by key mod 3)."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    shape = F.col("o_orderkey") % 3
    js = (F.when(shape == 0, F.concat(
        F.lit('{"rendered_fields": {"configuration": "Truncated. You can change this. {\'query\': {\'query\': '
              '\'SELECT cut_col, another_one FROM ds.cut_'), k, F.lit('...\'..."}}')))
        .when(shape == 1, F.concat(F.lit('{"sql": "SELECT a, b, rendered_column FROM ds.rendered_'), k, F.lit('"}'))))
    return o.select(F.concat(F.lit("dag_"), (F.col("o_custkey") % 20).cast("string")).alias("dag_id"),
                    F.concat(F.lit("run_"), k).alias("run_id"), F.concat(F.lit("load_"), k).alias("task_id"),
                    F.col("o_orderkey").alias("seq"), js.alias("rendered_fields"))
