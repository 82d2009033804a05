"""The stand-in views written as DuckDB SQL (independent re-statement of
``sources.standins`` used by the oracle queries)."""

TASK_INSTANCES = """
task_instances AS (
  SELECT event_id,
         'dag_' || CAST(user_id % 5 AS VARCHAR) AS dag_id,
         'task_' || CAST(user_id % 7 AS VARCHAR) AS task_id,
         'run_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'upstream_failed'
                         WHEN 'view' THEN 'running' ELSE 'success' END AS state,
         CASE WHEN event_type = 'view' THEN NULL ELSE value END AS duration_s,
         ts AS start_date,
         CAST(1 + event_id % 3 AS INTEGER) AS try_number,
         CASE event_type WHEN 'purchase' THEN 'BigQueryInsertJobOperator' WHEN 'click' THEN 'PythonOperator'
                         WHEN 'error' THEN 'BashOperator' WHEN 'signup' THEN 'TriggerDagRunOperator'
                         ELSE 'EmptyOperator' END AS operator,
         props AS rendered_fields
  FROM events)"""

DAG_RUNS = """
dag_runs AS (
  SELECT 'dag_' || CAST(o_custkey % 20 AS VARCHAR) AS dag_id,
         'run_' || CAST(o_orderkey AS VARCHAR) AS run_id,
         o_orderkey AS run_key,
         o_orderdate AS logical_date,
         o_orderdate + to_seconds(o_orderkey % 3600) AS start_date,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE o_orderdate + to_seconds(o_orderkey % 3600 + o_orderkey % 977) END AS end_date,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS state,
         o_orderpriority AS run_type
  FROM orders)"""

GIT_FILES = """
git_files AS (
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 9 = 0 THEN '.bin' ELSE '.sql' END AS raw_name,
         'sql/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 9 = 0 THEN '.bin' ELSE '.sql' END AS path,
         doc_id AS seq, text AS content
  FROM documents WHERE doc_id % 10 <> 0 OR doc_id % 70 = 0)"""

GCS_FILES = """
gcs_files AS (
  SELECT 'DOC-' || CAST(doc_id AS VARCHAR) || '_v' || CAST(doc_id % 3 + 1 AS VARCHAR) || '.sql' AS raw_name,
         'sql/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 9 = 0 THEN '.bin' ELSE '.sql' END AS path,
         doc_id AS seq,
         CASE WHEN doc_id % 11 = 0 THEN text || ' drift' ELSE text END AS content
  FROM documents WHERE doc_id % 7 <> 0)"""

MAPPING = """
mapping AS (
  SELECT 'Doc ' || CAST(doc_id AS VARCHAR) AS raw_name, doc_id AS seq,
         CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'p.d.t' || CAST(doc_id AS VARCHAR) END AS bq_table,
         ['dag_' || CAST(doc_id % 20 AS VARCHAR)] AS dag_names
  FROM documents WHERE doc_id % 3 <> 0)"""

SOURCE_COLUMNS = """
source_columns AS (
  SELECT 'tbl_' || CAST(p_size AS VARCHAR) AS table_name,
         'col_' || CAST(p_partkey AS VARCHAR) AS column_name,
         p_partkey AS ordinal_position,
         CASE WHEN starts_with(p_type, 'ECONOMY') THEN 'int'
              WHEN starts_with(p_type, 'LARGE') THEN 'VARCHAR '
              WHEN starts_with(p_type, 'MEDIUM') THEN 'decimal'
              WHEN starts_with(p_type, 'PROMO') THEN 'datetime'
              WHEN starts_with(p_type, 'SMALL') THEN 'bit'
              ELSE 'geometry' END AS data_type,
         CAST(CASE WHEN p_size % 2 = 0 THEN 1 WHEN p_size % 5 = 0 THEN NULL ELSE 0 END AS INTEGER) AS deployed_to_prod,
         CAST(CASE WHEN p_size % 10 = 3 THEN 0 ELSE 1 END AS INTEGER) AS is_streamed
  FROM part WHERE p_partkey % 17 <> 0 OR p_partkey % 85 = 0)"""

TARGET_COLUMNS = """
target_columns AS (
  SELECT 'tbl_' || CAST(p_size AS VARCHAR) AS table_name,
         'col_' || CAST(p_partkey AS VARCHAR) AS column_name,
         p_partkey AS ordinal_position,
         CASE WHEN p_partkey % 9 = 0 THEN 'BYTES'
              WHEN starts_with(p_type, 'ECONOMY') THEN 'INTEGER'
              WHEN starts_with(p_type, 'LARGE') THEN 'STRING'
              WHEN starts_with(p_type, 'MEDIUM') THEN 'BIGNUMERIC'
              WHEN starts_with(p_type, 'PROMO') THEN 'DATETIME'
              WHEN starts_with(p_type, 'SMALL') THEN 'BOOLEAN'
              ELSE 'GEOMETRY' END AS data_type,
         p_name AS description
  FROM part WHERE p_partkey % 5 <> 0)"""

LOG_LINES = """
log_lines AS (
  SELECT doc_id AS log_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no,
         unnest(string_split(text, chr(10))) AS line
  FROM documents)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"

TASK_LOGS = """
task_logs AS (
  SELECT dag_id, run_id, task_id, try_number, event_id AS line_no,
         concat_ws(' ', strftime(start_date, '%Y-%m-%d %H:%M:%S'),
                   CASE state WHEN 'failed' THEN 'ERROR' WHEN 'upstream_failed' THEN 'WARNING' ELSE 'INFO' END,
                   task_id, operator, 'duration=' || coalesce(CAST(duration_s AS VARCHAR), 'none')) AS line
  FROM task_instances)"""

ACKS = """
acks AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS logical_name, 'known' AS reason
         FROM documents WHERE doc_id % 8 = 1)"""

ORDERS_CHANGED = """
orders_b AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 89 <> 0
  UNION ALL SELECT * FROM orders WHERE o_orderkey % 83 = 0)"""


def norm_name(col: str) -> str:
    """The logical-name rule written for DuckDB."""
    base = f"regexp_extract({col}, '([^/]*)/*$', 1)"
    stem = f"regexp_replace({base}, '^(.+)[.][^.]+$', '\\1')"
    s = f"regexp_replace(lower({stem}), '[^a-z0-9]', '_', 'g')"
    s = f"regexp_replace({s}, '_+', '_', 'g')"
    s = f"regexp_replace({s}, '_v[0-9]+$', '')"
    return f"trim({s}, '_')"


def _template_values() -> str:
    from ..sources.standins import TASK_TEMPLATE
    rows = []
    for n, op, ds in TASK_TEMPLATE:
        arr = "[" + ", ".join(f"'line_{d}'" for d in ds) + "]" if ds else "CAST([] AS VARCHAR[])"
        rows.append(f"({n}, '{op}', {arr})")
    return ", ".join(rows)


TASK_DEFS = f"""
tmpl(n, operator, downstream_task_ids) AS (VALUES {_template_values()}),
dag_nums AS (SELECT dag_id, CAST(regexp_extract(dag_id, '([0-9]+)$', 1) AS INTEGER) AS dag_no,
                    unnest(range(1, 8)) AS n
             FROM (SELECT DISTINCT dag_id FROM dag_runs)),
task_defs AS (
  SELECT d.dag_id, 'line_' || CAST(d.n AS VARCHAR) AS task_id, t.operator, t.downstream_task_ids,
         CASE WHEN contains(t.operator, 'TriggerDagRun') THEN 'dag_' || CAST((d.dag_no + 1) % 20 AS VARCHAR) END AS trigger_dag_id,
         CASE WHEN starts_with(t.operator, 'BigQuery') THEN
           'SELECT * FROM ds.t_' || CAST(d.dag_no AS VARCHAR) || '_' || CAST(d.n AS VARCHAR) ||
           CASE WHEN d.n = 4 THEN ' WHERE DATE(load_ts) = CURRENT_DATE() AND k IN (SELECT k FROM ds.t_'
                                  || CAST(d.dag_no AS VARCHAR) || '_2)' ELSE '' END END AS sql
  FROM dag_nums d JOIN tmpl t ON t.n = d.n)"""

GRAPH_INSTANCES = """
graph_instances AS (
  SELECT r.dag_id, r.run_id, 'line_' || CAST(l.l_linenumber AS VARCHAR) AS task_id,
         CASE WHEN l.l_returnflag = 'R' THEN 'failed' WHEN l.l_linestatus = 'F' THEN 'success' ELSE 'running' END AS state,
         l.l_shipdate AS start_date,
         CASE WHEN l.l_linestatus = 'F' THEN l.l_shipdate + to_seconds(CAST(l.l_quantity * 60 AS BIGINT)) END AS end_date,
         l.l_quantity * 60 AS duration, 1 AS try_number,
         l.l_shipdate AS s1, l.l_partkey AS s2, l.l_suppkey AS s3, l.l_quantity AS s4, l.l_extendedprice AS s5
  FROM lineitem l JOIN dag_runs r ON r.run_key = l.l_orderkey)"""

PART_TREE = """
pe AS (SELECT 'dag_' || CAST(p_partkey % 20 AS VARCHAR) AS dag_id, 't' || CAST(p_partkey AS VARCHAR) AS src,
              unnest([(2 * (p_partkey // 20) + 1) * 20 + p_partkey % 20, (2 * (p_partkey // 20) + 2) * 20 + p_partkey % 20]) AS child
       FROM part WHERE NOT starts_with(p_type, 'SMALL')),
tree_edges AS (SELECT dag_id, src, 't' || CAST(child AS VARCHAR) AS dst FROM pe WHERE child IN (SELECT p_partkey FROM part)),
tree_nodes AS (SELECT 'dag_' || CAST(p_partkey % 20 AS VARCHAR) AS dag_id, 't' || CAST(p_partkey AS VARCHAR) AS task_id FROM part)"""

REGISTRY = """
registry AS (
  SELECT p_partkey AS pos,
         CASE WHEN p_partkey % 2 = 0 THEN 'mapping' ELSE 'master' END AS source_folder,
         lower(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN 'mapping' ELSE 'master' END || '_' ||
                              replace(p_brand, '#', '_') || ' ' || p_name, '[^A-Za-z0-9_]+', '_', 'g')) AS table_name,
         '/data/' || CASE WHEN p_partkey % 2 = 0 THEN 'mapping' ELSE 'master' END || '/' ||
           replace(p_brand, '#', '_') || ' ' || p_name || '.xlsx' AS file_path,
         replace(p_brand, '#', '_') || ' ' || p_name AS stem
  FROM part)"""

MAPPING_CONFIG = """
mc_rows AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN replace(p_brand, '#', '_') || ' ' || p_name
              ELSE lower(replace(p_brand, '#', '_') || ' ' || p_name) END AS stem, p_partkey AS seq,
         CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'ds.t' || CAST(p_partkey AS VARCHAR) END AS bq_table,
         ['dag_' || CAST(p_partkey % 20 AS VARCHAR)] AS dag_names
  FROM part WHERE p_partkey % 3 <> 0),
mapping_config AS (SELECT stem, bq_table, dag_names FROM mc_rows
                   QUALIFY row_number() OVER (PARTITION BY stem ORDER BY seq DESC) = 1)"""

NEEDLES = """
needles AS (SELECT DISTINCT needle FROM (
  SELECT unnest(string_split(p_name, ' ')) AS needle FROM part UNION ALL SELECT n_name FROM nation))"""

SQL_STATEMENTS = """
sql_statements AS (
  SELECT o_orderkey AS stmt_id, 'dag_' || CAST(o_custkey % 20 AS VARCHAR) AS dag_id,
    CASE o_orderkey % 6
      WHEN 0 THEN 'SELECT * FROM sales.orders_' || CAST(o_custkey AS VARCHAR)
      WHEN 1 THEN 'SELECT o_id, price FROM sales.orders_v WHERE UDF_CLEAN(o_id) = ' || CAST(o_orderkey AS VARCHAR)
      WHEN 2 THEN 'INSERT INTO mart.daily_' || CAST(o_custkey % 7 AS VARCHAR) || ' SELECT count(*) FROM sales.orders_'
                  || CAST(o_custkey AS VARCHAR) || ' WHERE o_date = DATE ''' || strftime(o_orderdate, '%Y-%m-%d') || ''''
      WHEN 3 THEN 'SELECT a FROM t WHERE a IN (SELECT k FROM ref.keys_' || CAST(o_custkey % 3 AS VARCHAR)
                  || ') OR b IN (SELECT k FROM ref.keys_' || CAST(o_custkey % 3 AS VARCHAR) || ')'
      WHEN 4 THEN '/* header */ MERGE INTO mart.cust_' || CAST(o_custkey AS VARCHAR) || ' USING stage.c ON TRUE -- SELECT * FROM x'
      ELSE 'WITH x AS (SELECT o.* FROM ops.orders o JOIN ops.lines l ON l.k = o.k) SELECT x.k FROM x WHERE lower(x.s) = ''f'' AND my_fn(x.p) > '
           || CAST(o_orderkey AS VARCHAR) END AS sql
  FROM orders)"""

RENDERED_JSON = """
rendered_json AS (
  SELECT event_id,
    CASE event_type
      WHEN 'purchase' THEN '{"configuration": {"query": {"query": "SELECT amount FROM sales WHERE user_id = '
                           || CAST(user_id AS VARCHAR) || '", "useLegacySql": false}}}'
      WHEN 'click' THEN '{"sql": "  SELECT * FROM clicks WHERE k = ' || json_extract_string(props, '$.k') || '  ", "bql": "x"}'
      WHEN 'error' THEN '{"bash_command": "exit 1", "env": {"Q": "WITH x AS (SELECT ' || CAST(event_id AS VARCHAR)
                        || ') SELECT * FROM x"}}'
      WHEN 'signup' THEN '{"rendered_fields": {"configuration": "Truncated. You can change this behaviour. '
                         || '{''query'': {''query'': ''SELECT id FROM users WHERE signup_id = ' || CAST(event_id AS VARCHAR)
                         || ''', ''useLegacySql'': False}}..."}}'
      ELSE '{"query": "short", "params": ["INSERT INTO t VALUES (' || CAST(event_id AS VARCHAR) || ', 1, 2, 3)"], "sql": "load/users_'
           || CAST(user_id AS VARCHAR) || '.sql"}' END AS fields
  FROM events)"""

DAG_SOURCE_LINES = """
dag_src AS (
  SELECT 'dags/dag_' || CAST(o_orderkey AS VARCHAR) || '.py' AS path, [
    'from airflow import DAG',
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'from airflow.operators.bash_operator import BashOperator'
         ELSE 'from airflow.operators.bash import BashOperator' END,
    'from airflow.models import Variable',
    CASE WHEN o_orderstatus = 'P' THEN 'TARGET = Variable.get(''target_' || CAST(o_custkey AS VARCHAR) || ''')'
         ELSE 'TARGET = ''ds_' || CAST(o_custkey AS VARCHAR) || '''' END,
    'with DAG(''dag_' || CAST(o_orderkey AS VARCHAR) || ''', start_date='
      || CASE WHEN o_orderkey % 4 = 0 THEN 'datetime.now()' ELSE 'datetime(2024, 1, 1)' END
      || ', schedule_interval=''@daily'''
      || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ', catchup=False' END
      || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ', default_args={''retries'': 2}' END || ') as dag:',
    '    start = ' || CASE WHEN o_orderkey % 2 = 0 THEN 'DummyOperator' ELSE 'EmptyOperator' END || '(task_id=''start'')',
    '    load = BashOperator(task_id=''load'', bash_command=''run.sh {{ '
      || CASE WHEN o_orderstatus = 'F' THEN 'execution_date' ELSE 'logical_date' END || ' }}'')',
    CASE WHEN o_orderkey % 7 = 0 THEN '    start.set_downstream(load)' ELSE '    start >> load' END,
    CASE WHEN o_orderkey % 3 = 0 THEN '    dag.doc_md = ''Loads order ' || CAST(o_orderkey AS VARCHAR) || '''' ELSE '' END
  ] AS lines FROM orders),
dag_source_lines AS (SELECT path, unnest(lines) AS line FROM dag_src)"""

DAGS = """
dags AS (
  SELECT 'dag_' || CAST(o_orderkey AS VARCHAR) AS dag_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN '@hourly' WHEN '5-LOW' THEN '' ELSE '@daily' END AS schedule_interval,
         o_orderstatus = 'P' AS is_paused,
         [{'name': 'team_' || CAST(o_custkey % 3 AS VARCHAR)}, {'name': 'prio_' || substr(o_orderpriority, 1, 1)}] AS tags,
         CASE WHEN o_orderkey % 5 = 0 THEN 'dag_' || CAST(o_orderkey AS VARCHAR) || '.py'
              ELSE '/home/airflow/gcs/dags/' || lower(o_orderstatus) || '/sales/dag_' || CAST(o_orderkey AS VARCHAR) || '.py'
         END AS file_loc
  FROM orders)"""

SAVED_QUERIES = """
saved_queries AS (
  SELECT conv_id * 100 + turn AS id, 'q_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS name,
         text AS sql, role AS source,
         CASE WHEN turn % 3 = 0 THEN NULL ELSE role || ' turn ' || CAST(turn AS VARCHAR) END AS description,
         ['Lang_' || CAST(conv_id % 4 AS VARCHAR), 'T' || CAST(turn AS VARCHAR)] AS tags
  FROM conversations)"""

GLOSSARY = """
glossary AS (
  SELECT term, min(item_id * 100000 + i - 1) AS pos, arg_max(definition, item_id) AS definition FROM (
    SELECT item_id, 'passage ' || CAST(item_id AS VARCHAR) AS definition, unnest(w) AS term,
           unnest(range(1, len(w) + 1)) AS i
    FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^\\pL]+') AS w FROM benchmark))
  WHERE length(term) >= 10 GROUP BY term)"""

RENDERED_INSTANCES = """
rendered_instances AS (
  SELECT i.dag_id, i.run_id, i.task_id, i.state, i.s1, i.s2, i.s3, i.s4, i.s5,
         CASE WHEN d.sql IS NOT NULL AND i.state = 'success'
              THEN replace(d.sql, 'CURRENT_DATE()', 'DATE ''' || strftime(r.logical_date, '%Y-%m-%d') || '''') END
           AS rendered_sql
  FROM graph_instances i JOIN task_defs d USING (dag_id, task_id) JOIN dag_runs r USING (dag_id, run_id))"""
