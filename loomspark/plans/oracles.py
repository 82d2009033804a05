"""DuckDB SQL oracles, one per registered query, over the same parquet tables.

Written independently of the Spark code (window ranks instead of the range-partitioned
order statistic, joins instead of tag-unions) so that agreement means something.
"""
from __future__ import annotations

from .oracle_standins import DAG_RUNS, LOG_LINES, TASK_INSTANCES, TASK_LOGS, with_

ORACLES: dict[str, str] = {}


def _exact_avg(x: str, n: str, digits: int) -> str:
    """Half-up rounded exact average of a DOUBLE column summed as DECIMAL(24,6)."""
    u = f"CAST(sum(CAST({x} AS DECIMAL(24,6))) * 1000000 AS HUGEINT)"
    scale = 10 ** (6 - digits)
    return f"(((2 * {u} + {n} * {scale}) // (2 * {n} * {scale})) / {10 ** digits}.0)"


def _exact_rate(ok: str, n: str, digits: int) -> str:
    return f"(((2 * {ok} * {10 ** digits} + {n}) // (2 * {n})) / {10 ** digits}.0)"


def _health(x: str, runs: str, ok: str, n: str) -> str:
    u = f"CAST(sum(CAST({x} AS DECIMAL(24,6))) * 1000000 AS HUGEINT)"
    return (f"CASE WHEN {u} >= 55000000 * {runs} OR {ok} * 100 < 36 * {n} THEN 'critical' "
            f"WHEN {u} >= 50000000 * {runs} OR {ok} * 100 < 40 * {n} THEN 'warning' ELSE 'healthy' END")

_OK = "count(*) FILTER (WHERE state = 'success')"
_PERF = with_(TASK_INSTANCES, f"""
stats AS (
  SELECT dag_id, task_id, {_exact_avg('duration_s', 'count(duration_s)', 2)} AS avg_duration_s,
         max(duration_s) AS m, count(duration_s) AS n,
         {_exact_rate(_OK, 'count(*)', 3)} AS success_rate,
         {_health('duration_s', 'count(duration_s)', _OK, 'count(*)')} AS health_status
  FROM task_instances GROUP BY dag_id, task_id HAVING count(duration_s) > 0),
ranked AS (
  SELECT dag_id, task_id, duration_s,
         row_number() OVER (PARTITION BY dag_id, task_id ORDER BY duration_s) AS rn
  FROM task_instances WHERE duration_s IS NOT NULL),
perf AS (
  SELECT s.dag_id, s.task_id, s.avg_duration_s, round(s.m, 2) AS max_duration_s,
         round(k.duration_s, 2) AS p95_duration_s, s.success_rate, s.n AS run_count, s.health_status
  FROM stats s JOIN ranked k ON k.dag_id = s.dag_id AND k.task_id = s.task_id
   AND k.rn = floor(s.n * CAST(0.95 AS DOUBLE)) + 1)
""")

ORACLES["task_performance"] = _PERF + "SELECT * FROM perf"

ORACLES["health_rollup"] = _PERF + """
SELECT dag_id,
       CAST(count(*) FILTER (WHERE health_status = 'healthy') AS BIGINT) AS healthy,
       CAST(count(*) FILTER (WHERE health_status = 'warning') AS BIGINT) AS warning,
       CAST(count(*) FILTER (WHERE health_status = 'critical') AS BIGINT) AS critical,
       CASE WHEN bool_or(health_status = 'critical') THEN 'critical'
            WHEN bool_or(health_status = 'warning') THEN 'warning' ELSE 'healthy' END AS overall_health
FROM perf GROUP BY dag_id"""

_HIST = with_(DAG_RUNS, """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY logical_date DESC, run_key DESC) AS recency
  FROM dag_runs),
hist AS (
  SELECT dag_id, run_id, logical_date, start_date AS start_time, end_date AS end_time,
         date_diff('microsecond', start_date, end_date) / 1e6 AS duration_s,
         state AS status, run_type AS triggered_by,
         row_number() OVER (PARTITION BY dag_id ORDER BY logical_date, run_key) AS run_number
  FROM ranked WHERE recency <= 10)
""")

ORACLES["run_history"] = _HIST + "SELECT * FROM hist"
ORACLES["trend_points"] = _HIST + "SELECT dag_id, run_number, duration_s FROM hist WHERE duration_s IS NOT NULL"

_JOBS_COLS = """dag_id, run_id, run_key, state, start_date AS start_time, end_date AS end_time,
       date_diff('microsecond', start_date, end_date) / 1e6 AS duration_s,
       run_type AS triggered_by, logical_date"""

ORACLES["jobs_all_dags"] = with_(DAG_RUNS, """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY logical_date DESC, run_key DESC) AS recency
  FROM dag_runs)
""") + f"""SELECT {_JOBS_COLS} FROM ranked WHERE recency <= 5
ORDER BY start_date DESC NULLS LAST, run_key DESC LIMIT 20"""

ORACLES["jobs_one_dag"] = with_(DAG_RUNS) + f"""SELECT {_JOBS_COLS} FROM dag_runs WHERE dag_id = 'dag_7'
ORDER BY logical_date DESC, run_key DESC LIMIT 20"""

ORACLES["latest_run"] = with_(DAG_RUNS) + """
SELECT dag_id, run_id, state, start_date, end_date, logical_date FROM (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY logical_date DESC, run_key DESC) AS r
  FROM dag_runs) WHERE r = 1"""

ORACLES["failed_tasks"] = with_(TASK_INSTANCES) + """
SELECT event_id, dag_id, run_id, task_id, state, try_number FROM task_instances
WHERE state IN ('failed', 'upstream_failed')"""

ORACLES["first_failed"] = with_(TASK_INSTANCES) + """
SELECT dag_id, run_id, task_id, event_id, state, position FROM (
  SELECT *, row_number() OVER (PARTITION BY dag_id, run_id ORDER BY event_id) AS position
  FROM task_instances WHERE state IN ('failed', 'upstream_failed')) WHERE position <= 5"""

ORACLES["log_error_lines"] = with_(TASK_INSTANCES, TASK_LOGS) + """
SELECT dag_id, run_id, task_id, line_no, line FROM task_logs
WHERE contains(line, 'ERROR') OR contains(line, 'Traceback') OR contains(line, 'Exception')"""

ORACLES["log_tail"] = with_(LOG_LINES) + """
SELECT log_id, line_no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) AS r FROM log_lines) WHERE r <= 50"""

ORACLES["log_summary"] = with_(TASK_INSTANCES, TASK_LOGS) + """
SELECT dag_id, run_id, task_id, count(*) AS line_count,
       CAST(count(*) FILTER (WHERE contains(line, 'ERROR') OR contains(line, 'CRITICAL')
            OR contains(line, 'Traceback') OR contains(line, 'Exception')) AS BIGINT) AS error_count
FROM task_logs GROUP BY ALL"""

# ── reconcile, folder compare, result compare ─────────────────────────────────
from .oracle_standins import ACKS, GCS_FILES, GIT_FILES, MAPPING, ORDERS_CHANGED, norm_name  # noqa: E402

_RECON_BASE = with_(GIT_FILES, GCS_FILES, MAPPING, ACKS, f"""
g AS (SELECT {norm_name('raw_name')} AS logical_name, content, seq FROM git_files
      QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY seq DESC) = 1),
c AS (SELECT {norm_name('raw_name')} AS logical_name, content, seq FROM gcs_files
      QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY seq DESC) = 1),
m AS (SELECT {norm_name('raw_name')} AS logical_name, bq_table, seq FROM mapping
      QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY seq DESC) = 1),
names AS (SELECT logical_name FROM g UNION SELECT logical_name FROM c UNION SELECT logical_name FROM m),
joined AS (
  SELECT n.logical_name, g.logical_name IS NOT NULL AS in_git, c.logical_name IS NOT NULL AS in_gcs,
         m.logical_name IS NOT NULL AS in_mapping, a.logical_name IS NOT NULL AS acknowledged,
         g.content AS gc, c.content AS cc, m.bq_table
  FROM names n LEFT JOIN g USING (logical_name) LEFT JOIN c USING (logical_name)
  LEFT JOIN m USING (logical_name) LEFT JOIN (SELECT DISTINCT logical_name FROM acks) a USING (logical_name)),
findings AS (
  SELECT logical_name,
         CASE WHEN in_mapping AND coalesce(bq_table, '') = '' THEN 'bq_missing'
              WHEN in_git AND in_gcs AND in_mapping THEN
                CASE WHEN coalesce(gc, '') <> '' AND coalesce(cc, '') <> ''
                      AND regexp_replace(gc, '^\\s+|\\s+$', '', 'g') = regexp_replace(cc, '^\\s+|\\s+$', '', 'g')
                     THEN 'in_sync' ELSE 'content_drift' END
              WHEN in_git AND in_gcs THEN 'undeclared'
              WHEN in_git AND in_mapping THEN 'not_deployed'
              WHEN in_gcs AND in_mapping THEN 'no_source'
              WHEN in_git THEN 'git_only'
              WHEN in_gcs THEN 'gcs_orphan'
              ELSE 'mapping_ghost' END AS status,
         acknowledged, in_git, in_gcs, in_mapping, coalesce(bq_table, '') AS bq_table
  FROM joined),
f AS (SELECT *, status IN ('content_drift', 'not_deployed', 'no_source', 'mapping_ghost') AND NOT acknowledged AS critical
      FROM findings)
""")

ORACLES["reconcile"] = _RECON_BASE + "SELECT * FROM f ORDER BY logical_name"

ORACLES["reconcile_summary"] = _RECON_BASE + """
SELECT s.status, CAST(coalesce(x.n, 0) AS BIGINT) AS n
FROM (VALUES ('in_sync'), ('content_drift'), ('schema_drift'), ('undeclared'), ('not_deployed'),
             ('no_source'), ('git_only'), ('gcs_orphan'), ('mapping_ghost'), ('bq_missing')) s(status)
LEFT JOIN (SELECT status, count(*) AS n FROM f GROUP BY status) x USING (status)"""

ORACLES["reconcile_groups"] = _RECON_BASE + """
SELECT CAST(count(*) FILTER (WHERE status = 'in_sync') AS BIGINT) AS in_sync,
       CAST(count(*) FILTER (WHERE status IN ('undeclared','not_deployed','gcs_orphan','git_only','bq_missing')) AS BIGINT) AS warnings,
       CAST(count(*) FILTER (WHERE status IN ('content_drift','schema_drift','no_source','mapping_ghost')) AS BIGINT) AS critical,
       CAST(count(*) FILTER (WHERE critical) AS BIGINT) AS critical_open,
       CAST(count(*) AS BIGINT) AS total
FROM f"""

ORACLES["reconcile_scope"] = _RECON_BASE + "SELECT * FROM f WHERE in_git AND in_gcs"

ORACLES["reconcile_filtered"] = _RECON_BASE + """
SELECT * FROM f WHERE contains(logical_name, 'doc_1') AND status = 'content_drift'"""

ORACLES["distinct_statuses"] = _RECON_BASE + "SELECT DISTINCT status FROM f ORDER BY status"

ORACLES["normalise_names"] = f"""
WITH r AS (SELECT doc_id, 'sql/' || source || '/' || upper(lang) || '-Doc.' || CAST(doc_id AS VARCHAR)
                          || '_v' || CAST(doc_id % 4 AS VARCHAR) || '.sql' AS raw_name FROM documents)
SELECT doc_id, raw_name, {norm_name('raw_name')} AS logical_name FROM r"""

ORACLES["safe_table_names"] = """
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || '_' || p_name), '[^a-z0-9_]', '_', 'g'),
                                      '_+', '_', 'g'), '_') AS table_name
FROM part"""

_CMP = with_(GIT_FILES, GCS_FILES, """
gt AS (SELECT substr(path, 5) AS rel_path, sha256(content) AS h, CAST(strlen(content) AS BIGINT) AS size
       FROM git_files WHERE starts_with(path, 'sql/') AND substr(path, 5) <> ''),
ct AS (SELECT substr(path, 5) AS rel_path, sha256(content) AS h, CAST(strlen(content) AS BIGINT) AS size
       FROM gcs_files WHERE starts_with(path, 'sql/') AND substr(path, 5) <> ''),
cmp AS (
  SELECT coalesce(gt.rel_path, ct.rel_path) AS rel_path,
         CASE WHEN ct.rel_path IS NULL THEN 'only_in_git'
              WHEN gt.rel_path IS NULL THEN 'only_in_gcs'
              WHEN lower(regexp_extract(gt.rel_path, '^.+([.][^.]+)$', 1))
                   NOT IN ('.sql','.py','.yaml','.yml','.json','.txt','.sh') THEN 'identical'
              WHEN gt.h IS NULL OR ct.h IS NULL THEN 'different'
              WHEN gt.h = ct.h THEN 'identical' ELSE 'different' END AS status,
         CAST(gt.size AS DOUBLE) AS git_size, CAST(ct.size AS DOUBLE) AS gcs_size,
         CAST(ct.size - gt.size AS DOUBLE) AS size_delta,
         CASE WHEN gt.rel_path IS NOT NULL AND ct.rel_path IS NOT NULL
               AND lower(regexp_extract(gt.rel_path, '^.+([.][^.]+)$', 1)) IN ('.sql','.py','.yaml','.yml','.json','.txt','.sh')
               AND (gt.h IS NULL OR ct.h IS NULL) THEN 'Could not fetch content for comparison' END AS note
  FROM gt FULL OUTER JOIN ct ON gt.rel_path = ct.rel_path)
""")

ORACLES["compare_folders"] = _CMP + "SELECT * FROM cmp"

# a drifted copy ends in ' drift': its last line is another, or a new one where the text ends with its last line's end
ORACLES["folder_line_changes"] = _CMP + """
SELECT cmp.rel_path, CASE WHEN g.content = '' OR regexp_matches(g.content, '[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]$')
                          THEN 0 ELSE 1 END AS removed, 1 AS added
FROM cmp JOIN git_files g ON g.path = 'sql/' || cmp.rel_path
WHERE cmp.status = 'different' AND cmp.note IS NULL"""

ORACLES["compare_summary"] = _CMP + """
SELECT CAST(count(*) FILTER (WHERE status = 'only_in_git') AS BIGINT) AS only_in_git,
       CAST(count(*) FILTER (WHERE status = 'only_in_gcs') AS BIGINT) AS only_in_gcs,
       CAST(count(*) FILTER (WHERE status = 'identical') AS BIGINT) AS identical,
       CAST(count(*) FILTER (WHERE status = 'different') AS BIGINT) AS different,
       CAST(count(*) FILTER (WHERE status <> 'only_in_gcs') AS BIGINT) AS total_git,
       CAST(count(*) FILTER (WHERE status <> 'only_in_git') AS BIGINT) AS total_gcs
FROM cmp"""

ORACLES["compare_one_file"] = with_(GIT_FILES, GCS_FILES, """
gt AS (SELECT substr(path, 10) AS rel_path, content FROM git_files WHERE starts_with(path, 'sql/src2/')),
ct AS (SELECT substr(path, 10) AS rel_path, content FROM gcs_files WHERE starts_with(path, 'sql/src2/'))
""") + """
SELECT coalesce(gt.rel_path, ct.rel_path) AS rel_path,
       CASE WHEN ct.rel_path IS NULL THEN 'only_in_git' WHEN gt.rel_path IS NULL THEN 'only_in_gcs'
            WHEN gt.content = ct.content THEN 'identical' ELSE 'different' END AS status,
       CAST(strlen(gt.content) AS DOUBLE) AS git_size, CAST(strlen(ct.content) AS DOUBLE) AS gcs_size,
       CAST(strlen(ct.content) - strlen(gt.content) AS DOUBLE) AS size_delta,
       CAST(NULL AS VARCHAR) AS note
FROM (SELECT * FROM gt WHERE rel_path = 'doc_22.sql') gt
FULL OUTER JOIN (SELECT * FROM ct WHERE rel_path = 'doc_22.sql') ct ON gt.rel_path = ct.rel_path"""

_ROWCMP = with_(ORDERS_CHANGED, """
ea AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders_b),
eb AS (SELECT * FROM orders_b EXCEPT ALL SELECT * FROM orders)
""")

ORACLES["compare_results"] = _ROWCMP + """
SELECT CASE WHEN (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders_b)
             AND (SELECT count(*) FROM ea) = 0 AND (SELECT count(*) FROM eb) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       (SELECT count(*) FROM orders) AS row_count_a, (SELECT count(*) FROM orders_b) AS row_count_b,
       true AS columns_match,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns_a,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns_b,
       (SELECT count(*) FROM ea) = 0 AND (SELECT count(*) FROM eb) = 0 AS data_match,
       (SELECT count(*) FROM ea) AS only_in_a, (SELECT count(*) FROM eb) AS only_in_b"""

ORACLES["compare_results_same"] = """
SELECT 'PASS' AS status, count(*) AS row_count_a, count(*) AS row_count_b, true AS columns_match,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns_a,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns_b,
       true AS data_match, CAST(0 AS BIGINT) AS only_in_a, CAST(0 AS BIGINT) AS only_in_b
FROM orders"""

ORACLES["row_diff"] = _ROWCMP + """
SELECT * FROM (SELECT 'only_in_a' AS side, * FROM ea UNION ALL SELECT 'only_in_b' AS side, * FROM eb)
ORDER BY side, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority LIMIT 100"""

ORACLES["row_diff_all"] = _ROWCMP + """
SELECT 'only_in_a' AS side, *, count(*) AS times FROM ea GROUP BY ALL
UNION ALL SELECT 'only_in_b' AS side, *, count(*) AS times FROM eb GROUP BY ALL"""

ORACLES["verdict"] = _ROWCMP + """
SELECT CASE WHEN (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders_b)
             AND (SELECT count(*) FROM ea) = 0 AND (SELECT count(*) FROM eb) = 0 THEN 'SAFE' ELSE 'UNSAFE' END AS verdict,
       CASE WHEN (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders_b)
             AND (SELECT count(*) FROM ea) = 0 AND (SELECT count(*) FROM eb) = 0 THEN 'PASS' ELSE 'FAIL' END AS comparison_status,
       CAST(0 AS BIGINT) AS failed_checks"""

# ── schema audit ──────────────────────────────────────────────────────────────
from ..functions.types import SOURCE_TO_TARGET, TARGET_ALIASES  # noqa: E402
from .oracle_standins import SOURCE_COLUMNS, TARGET_COLUMNS  # noqa: E402


def _case(expr: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _expected(x: str) -> str:
    return _case(f"lower(trim({x}))", SOURCE_TO_TARGET, f"upper(trim({x}))")


def _canon(x: str) -> str:
    return _case(f"upper(trim({x}))", TARGET_ALIASES, f"upper(trim({x}))")


_AUDIT = with_(SOURCE_COLUMNS, TARGET_COLUMNS, f"""
meta AS (SELECT d.table_name, d.column_name, d.ordinal_position, d.data_type, h.deployed_to_prod
         FROM source_columns d JOIN (SELECT DISTINCT table_name, deployed_to_prod, is_streamed FROM source_columns) h
           ON d.table_name = h.table_name WHERE h.is_streamed = 1),
tables AS (SELECT DISTINCT table_name, CASE WHEN deployed_to_prod = 1 THEN 'prod' ELSE 'uat' END AS batch FROM meta),
s AS (SELECT table_name, column_name, ordinal_position, trim(data_type) AS t FROM meta
      QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY ordinal_position DESC) = 1),
t AS (SELECT table_name, column_name, ordinal_position, trim(data_type) AS t, coalesce(description, '') AS d
      FROM target_columns WHERE table_name IN (SELECT table_name FROM tables)
      QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY ordinal_position DESC) = 1),
j AS (
  SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.column_name, t.column_name) AS column_name,
         CAST(s.ordinal_position AS DOUBLE) AS source_ordinal, CAST(t.ordinal_position AS DOUBLE) AS target_ordinal,
         coalesce(s.t, '') AS source_type,
         CASE WHEN s.column_name IS NULL OR coalesce(s.t, '') = '' THEN '' ELSE {_expected('s.t')} END AS expected_type,
         coalesce(t.t, '') AS actual_type, coalesce(t.d, '') AS target_description,
         s.column_name IS NOT NULL AS in_s, t.column_name IS NOT NULL AS in_t
  FROM s FULL OUTER JOIN t ON s.table_name = t.table_name AND s.column_name = t.column_name),
audit AS (
  SELECT tables.batch, j.table_name, column_name, source_ordinal, target_ordinal, source_type, expected_type,
         actual_type, target_description,
         CASE WHEN NOT in_s THEN 'Target Only' WHEN NOT in_t THEN 'Source Only'
              WHEN expected_type <> '' AND actual_type <> '' AND {_canon('actual_type')} <> {_canon('expected_type')}
              THEN 'Type Mismatch' ELSE 'Match' END AS status
  FROM j JOIN tables USING (table_name))
""")

ORACLES["schema_audit"] = _AUDIT + "SELECT * FROM audit"

ORACLES["audit_summary"] = _AUDIT + """
SELECT batch, CAST(count(DISTINCT table_name) AS BIGINT) AS tables, CAST(count(*) AS BIGINT) AS total_columns,
       CAST(count(*) FILTER (WHERE status = 'Match') AS BIGINT) AS match,
       CAST(count(*) FILTER (WHERE status = 'Type Mismatch') AS BIGINT) AS type_mismatch,
       CAST(count(*) FILTER (WHERE status = 'Target Only') AS BIGINT) AS target_only,
       CAST(count(*) FILTER (WHERE status = 'Source Only') AS BIGINT) AS source_only,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE status = 'Match') * 100.0 / count(*), 1)
            ELSE 0.0 END AS match_pct
FROM audit GROUP BY batch"""

ORACLES["audit_findings"] = _AUDIT + "SELECT * FROM audit WHERE status <> 'Match'"

ORACLES["column_metadata"] = _AUDIT + """
SELECT table_name, column_name, ordinal_position, data_type, CAST(deployed_to_prod AS DOUBLE) AS deployed_to_prod
FROM meta ORDER BY table_name, ordinal_position"""

ORACLES["schema_ddl"] = _AUDIT + f"""
SELECT batch, table_name, ordinal_position AS position, column_name AS name,
       CASE WHEN coalesce(trim(data_type), '') = '' THEN '' ELSE {_expected('data_type')} END AS type,
       'NULLABLE' AS mode
FROM meta JOIN tables USING (table_name)"""

ORACLES["audit_labels"] = """
WITH d AS (SELECT DISTINCT p_brand || ':' || p_name AS table_name FROM part),
c AS (SELECT table_name, substr(regexp_replace(table_name, '[\\\\/?*\\[\\]:]', '_', 'g'), 1, 31) AS clean FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY table_name)
                + CASE WHEN clean = 'Summary' THEN 1 ELSE 0 END AS i FROM c)
SELECT table_name, CASE WHEN i = 1 THEN clean
                        ELSE substr(clean, 1, 31 - length(CAST(i AS VARCHAR)) - 1) || '_' || CAST(i AS VARCHAR) END AS label
FROM r"""

ORACLES["leaf_profile"] = """
SELECT path, type, mode, non_null, row_count FROM (
  SELECT 'c_custkey' AS path, 'bigint' AS type, 'NULLABLE' AS mode, count(c_custkey) AS non_null, count(*) AS row_count FROM customer
  UNION ALL SELECT 'profile.name', 'string', 'NULLABLE', count(c_name), count(*) FROM customer
  UNION ALL SELECT 'profile.geo.nation', 'int', 'NULLABLE', count(c_nationkey), count(*) FROM customer
  UNION ALL SELECT 'profile.geo.segment', 'string', 'NULLABLE', count(c_mktsegment), count(*) FROM customer
  UNION ALL SELECT 'account.balance', 'double', 'NULLABLE', count(c_acctbal), count(*) FROM customer
  UNION ALL SELECT 'tags', 'array<string>', 'REPEATED', count(CASE WHEN c_acctbal > 0 THEN 1 END), count(*) FROM customer)"""

ORACLES["leaf_profile_nested"] = """
WITH l AS (SELECT count(l_partkey) AS parts, count(CASE WHEN l_discount > 0 THEN 1 END) AS rates,
                  count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS flags, count(CASE WHEN l_quantity > 25 THEN 1 END) AS lots
           FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
counts AS (
  SELECT 'o_orderkey' AS path, 'bigint' AS type, 'NULLABLE' AS mode, count(o_orderkey) AS non_null FROM orders
  UNION ALL SELECT 'paid.total', 'double', 'NULLABLE', count(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END) FROM orders
  UNION ALL SELECT p.prefix || x.leaf, x.type, 'REPEATED',
    CASE x.leaf WHEN 'part' THEN parts WHEN 'off.rate' THEN rates WHEN 'back.flag''s' THEN flags ELSE lots END
  FROM l, (VALUES ('content.items.'), ('content.groups.')) p(prefix),
    (VALUES ('part', 'bigint'), ('off.rate', 'double'), ('back.flag''s', 'string'), ('lots', 'array<double>')) x(leaf, type))
SELECT path, type, mode, non_null, (SELECT count(*) FROM orders) AS row_count FROM counts"""

# ── delegated SQL ─────────────────────────────────────────────────────────────
from .delegated import DELEGATED  # noqa: E402

for _name, (_tables, _spark_sql, _duck_sql) in DELEGATED.items():
    if _duck_sql is not None:
        ORACLES[_name] = _duck_sql

# ── lineage ───────────────────────────────────────────────────────────────────
from .oracle_standins import (GRAPH_INSTANCES, MAPPING_CONFIG, NEEDLES, PART_TREE,  # noqa: E402
                              REGISTRY, TASK_DEFS)

_GRAPH = with_(DAG_RUNS, TASK_DEFS, GRAPH_INSTANCES, """
latest AS (SELECT dag_id, run_id, state AS run_state FROM (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY logical_date DESC, run_key DESC) AS r FROM dag_runs) WHERE r = 1),
inst AS (SELECT * FROM graph_instances WHERE (dag_id, run_id) IN (SELECT (dag_id, run_id) FROM latest)
         QUALIFY row_number() OVER (PARTITION BY dag_id, run_id, task_id ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC) = 1)
""")

ORACLES["task_graph"] = _GRAPH + """
SELECT t.dag_id, l.run_id, l.run_state, t.task_id, t.operator, array_to_string(t.downstream_task_ids, ', ') AS downstream,
       i.state, i.start_date AS start_time, i.end_date AS end_time,
       CASE WHEN i.end_date IS NULL OR i.start_date IS NULL OR i.end_date = i.start_date THEN i.duration
            ELSE date_diff('microsecond', i.start_date, i.end_date) / 1e6 END AS duration_s,
       CAST(i.try_number AS DOUBLE) AS try_number, t.trigger_dag_id
FROM task_defs t LEFT JOIN latest l ON l.dag_id = t.dag_id
LEFT JOIN inst i ON i.dag_id = t.dag_id AND i.run_id = l.run_id AND i.task_id = t.task_id"""

ORACLES["task_roots"] = with_(DAG_RUNS, TASK_DEFS) + """
SELECT dag_id, task_id, operator FROM task_defs t
WHERE NOT EXISTS (SELECT 1 FROM task_defs u WHERE u.dag_id = t.dag_id AND list_contains(u.downstream_task_ids, t.task_id))"""

ORACLES["child_dag_edges"] = with_(DAG_RUNS, TASK_DEFS) + """
SELECT DISTINCT dag_id, trigger_dag_id AS child_dag_id FROM task_defs WHERE trigger_dag_id IS NOT NULL"""

_EVERY_MAPPING = MAPPING.replace("WHERE doc_id % 3 <> 0", "")
ORACLES["lineage_edges"] = with_(DAG_RUNS, TASK_DEFS, _EVERY_MAPPING) + """
SELECT 'excel:' || raw_name AS src, 'dag:' || unnest(dag_names) AS dst, 'excel_dag' AS kind FROM mapping
UNION ALL
SELECT 'dag:' || dag_id, 'task:' || dag_id || '.' || task_id, 'dag_task' FROM task_defs t
WHERE NOT EXISTS (SELECT 1 FROM task_defs u WHERE u.dag_id = t.dag_id AND list_contains(u.downstream_task_ids, t.task_id))
UNION ALL
SELECT 'task:' || dag_id || '.' || task_id, 'task:' || dag_id || '.' || unnest(downstream_task_ids), 'task_task' FROM task_defs
UNION ALL
SELECT 'task:' || dag_id || '.' || task_id, 'sql:' || dag_id || '.' || task_id, 'task_sql' FROM task_defs
WHERE length(trim(coalesce(sql, ''))) > 0"""

ORACLES["sql_coverage"] = with_(DAG_RUNS, TASK_DEFS) + """
SELECT dag_id, count(*) AS tasks, count(*) FILTER (WHERE length(trim(coalesce(sql, ''))) > 0) AS tasks_with_sql
FROM task_defs GROUP BY dag_id"""

ORACLES["task_depth"] = "WITH RECURSIVE " + PART_TREE + """, walk(dag_id, task_id, depth) AS (
  SELECT dag_id, task_id, 0 FROM tree_nodes n
  WHERE NOT EXISTS (SELECT 1 FROM tree_edges e WHERE e.dag_id = n.dag_id AND e.dst = n.task_id)
  UNION ALL
  SELECT e.dag_id, e.dst, w.depth + 1 FROM walk w JOIN tree_edges e ON e.dag_id = w.dag_id AND e.src = w.task_id)
SELECT dag_id, task_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY dag_id, task_id"""

ORACLES["task_structure"] = "WITH RECURSIVE " + PART_TREE + """,
bk AS (SELECT p_partkey AS k, p_partkey % 20 AS dag, p_partkey // 20 AS i FROM part),
backs AS (SELECT k, dag, (i - 1) // 2 AS up FROM bk WHERE k % 7 = 0 AND i >= 1
  UNION ALL SELECT k, dag, ((i - 1) // 2 - 1) // 2 FROM bk WHERE k % 11 = 0 AND i >= 3
  UNION ALL SELECT k, dag, i FROM bk WHERE k % 31 = 0),
es AS (SELECT src, dst FROM tree_edges UNION
  SELECT 't' || CAST(k AS VARCHAR), 't' || CAST(up * 20 + dag AS VARCHAR) FROM backs
  WHERE up * 20 + dag IN (SELECT p_partkey FROM part)),
reach(a, b) AS (SELECT src, dst FROM es UNION SELECT r.a, e.dst FROM reach r JOIN es e ON e.src = r.b),
rings AS (SELECT x.a AS v, min(x.b) AS cycle_id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
entered AS (SELECT DISTINCT d.cycle_id FROM es e JOIN rings d ON d.v = e.dst LEFT JOIN rings s ON s.v = e.src
            WHERE s.cycle_id IS DISTINCT FROM d.cycle_id),
starts AS (SELECT task_id AS v FROM tree_nodes WHERE task_id NOT IN (SELECT dst FROM es)
  UNION SELECT v FROM rings WHERE cycle_id NOT IN (SELECT cycle_id FROM entered)),
walk(v, depth) AS (SELECT v, 0 FROM starts UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN es e ON e.src = w.v WHERE w.depth < 60),
depths AS (SELECT v, min(depth) AS depth FROM walk GROUP BY v),
ins AS (SELECT dst AS v, count(*) AS n FROM es GROUP BY dst)
SELECT n.dag_id, n.task_id, CAST(d.depth AS BIGINT) AS depth, r.cycle_id, greatest(coalesce(i.n, 0) - 1, 0) AS revisits
FROM tree_nodes n LEFT JOIN depths d ON d.v = n.task_id LEFT JOIN rings r ON r.v = n.task_id LEFT JOIN ins i ON i.v = n.task_id"""

_LOOKUP = with_(REGISTRY, NEEDLES, """
firsts AS (
  SELECT n.needle, min(r.pos) AS pos FROM needles n JOIN registry r
    ON contains(lower(coalesce(r.file_path, '') || chr(1) || coalesce(r.table_name, '')), lower(n.needle))
  WHERE length(n.needle) > 0 GROUP BY n.needle),
looked AS (SELECT n.needle, f.pos FROM needles n LEFT JOIN firsts f USING (needle) WHERE length(n.needle) > 0)
""")

ORACLES["lookup_first"] = _LOOKUP + """
SELECT l.needle, CAST(l.pos AS DOUBLE) AS pos, r.table_name, r.file_path FROM looked l LEFT JOIN registry r USING (pos)"""

_MAPLOOK = """
ml AS (
  SELECT r.pos, r.file_path, r.stem,
         CASE WHEN e.stem IS NOT NULL THEN e.bq_table ELSE l.bq_table END AS bq_table,
         coalesce(CASE WHEN e.stem IS NOT NULL THEN e.dag_names ELSE l.dag_names END, CAST([] AS VARCHAR[])) AS dag_names
  FROM registry r LEFT JOIN mapping_config e ON e.stem = r.stem
  LEFT JOIN mapping_config l ON l.stem = lower(r.stem))"""

ORACLES["mapping_lookup"] = with_(REGISTRY, MAPPING_CONFIG, _MAPLOOK) + """
SELECT pos, file_path, bq_table, array_to_string(dag_names, ',') AS dag_names FROM ml"""

_TRACE = with_(DAG_RUNS, TASK_DEFS, GRAPH_INSTANCES, REGISTRY, MAPPING_CONFIG, NEEDLES, _MAPLOOK, """
firsts AS (
  SELECT n.needle, min(r.pos) AS pos FROM needles n JOIN registry r
    ON contains(lower(coalesce(r.file_path, '') || chr(1) || coalesce(r.table_name, '')), lower(n.needle))
  WHERE length(n.needle) > 0 GROUP BY n.needle),
looked AS (SELECT n.needle, f.pos FROM needles n LEFT JOIN firsts f USING (needle) WHERE length(n.needle) > 0),
per_dag AS (
  SELECT l.needle, r.table_name, m.bq_table, d.dag_id
  FROM looked l JOIN registry r USING (pos) JOIN ml m USING (pos)
  LEFT JOIN (SELECT pos, unnest(dag_names) AS dag_id FROM ml) d USING (pos)),
recent AS (SELECT dag_id, run_id, state, recency, start_date, end_date FROM (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY start_date DESC, run_key DESC) AS recency FROM dag_runs)
  WHERE recency <= 5),
tstat AS (SELECT dag_id, run_id, count(DISTINCT task_id) AS tasks_run,
                 count(DISTINCT CASE WHEN state = 'failed' THEN task_id END) AS tasks_failed
          FROM graph_instances WHERE (dag_id, run_id) IN (SELECT (dag_id, run_id) FROM recent) GROUP BY ALL),
cov AS (SELECT dag_id, count(*) AS tasks, count(*) FILTER (WHERE length(trim(coalesce(sql, ''))) > 0) AS tasks_with_sql
        FROM task_defs GROUP BY dag_id)
""")

ORACLES["trace"] = _TRACE + """
SELECT p.needle, p.table_name, p.bq_table, p.dag_id, r.run_id, r.state AS run_state, CAST(r.recency AS DOUBLE) AS recency,
       CAST(coalesce(t.tasks_run, 0) AS BIGINT) AS tasks_run, CAST(coalesce(t.tasks_failed, 0) AS BIGINT) AS tasks_failed,
       CAST(coalesce(c.tasks, 0) AS BIGINT) AS tasks, CAST(coalesce(c.tasks_with_sql, 0) AS BIGINT) AS tasks_with_sql,
       CASE WHEN p.dag_id IS NULL THEN 'no_dag' WHEN r.run_id IS NULL THEN 'no_runs' ELSE 'ok' END AS status
FROM per_dag p LEFT JOIN recent r USING (dag_id) LEFT JOIN tstat t ON t.dag_id = p.dag_id AND t.run_id = r.run_id
LEFT JOIN cov c ON c.dag_id = p.dag_id
UNION ALL
SELECT needle, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, 0, 0, 'not_found' FROM looked WHERE pos IS NULL"""

ORACLES["trace_runs"] = _TRACE + """
SELECT p.needle, p.dag_id, r.recency, r.run_id, r.state, r.start_date AS start_time, r.end_date AS end_time,
       CAST(epoch_us(r.end_date) - epoch_us(r.start_date) AS DOUBLE) / 1000000 AS duration_s
FROM per_dag p JOIN recent r USING (dag_id)"""

ORACLES["trace_tasks"] = _TRACE + """
SELECT p.needle, p.dag_id, t.task_id, t.operator, array_to_string(t.downstream_task_ids, ', ') AS downstream,
       i.run_id, i.state, i.duration AS duration_s
FROM per_dag p JOIN task_defs t USING (dag_id)
LEFT JOIN (SELECT g.* FROM graph_instances g JOIN recent r ON r.dag_id = g.dag_id AND r.run_id = g.run_id AND r.recency = 1
           QUALIFY row_number() OVER (PARTITION BY g.dag_id, g.task_id
                                      ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC) = 1) i
  ON i.dag_id = t.dag_id AND i.task_id = t.task_id"""

ORACLES["lineage_nodes"] = with_(DAG_RUNS, TASK_DEFS, _EVERY_MAPPING) + """
SELECT 'excel:' || raw_name AS id, 'excel' AS type, raw_name AS label, bq_table AS detail FROM mapping UNION
SELECT 'dag:' || dag_id, 'dag', dag_id, NULL FROM (SELECT unnest(dag_names) AS dag_id FROM mapping UNION SELECT dag_id FROM task_defs) UNION
SELECT 'task:' || dag_id || '.' || task_id, 'task', task_id, operator FROM task_defs UNION
SELECT 'sql:' || dag_id || '.' || task_id, 'sql', task_id, sql FROM task_defs WHERE length(trim(sql)) > 0"""

# ── SQL text, JSON, prompts, lint, formats ────────────────────────────────────
from ..operators.textjobs import FLAG_INFO, LINE_RULES, MISSING_RULES  # noqa: E402
from .oracle_standins import DAG_SOURCE_LINES, RENDERED_JSON  # noqa: E402


def _q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# What each of the six shapes of statements holds is known from how the stand-in makes them,
# so these oracles state the answers and do not repeat the rules.
_FLAGGED = """
SELECT o_orderkey AS stmt_id, x.flag AS flag_type, x.fn FROM orders, (VALUES
  (0, 'select_star', NULL), (0, 'full_table_scan', NULL), (1, 'non_sargable', 'UDF_CLEAN'),
  (2, 'select_star', NULL), (3, 'repeated_subquery', NULL), (4, 'full_table_scan', NULL),
  (5, 'select_star', NULL), (5, 'non_sargable', 'my_fn')) x(shape, flag, fn)
WHERE o_orderkey % 6 = x.shape"""

ORACLES["sql_flags"] = f"""
SELECT stmt_id, flag_type,
       CASE flag_type {' '.join(f"WHEN {_q(k)} THEN {_q(v[0])}" for k, v in FLAG_INFO.items())} END AS severity,
       CASE WHEN fn IS NOT NULL
            THEN 'Function ' || chr(39) || fn || chr(39) || ' applied to column in WHERE — may prevent partition/index use.'
            ELSE CASE flag_type {' '.join(f"WHEN {_q(k)} THEN {_q(v[1])}" for k, v in FLAG_INFO.items())} END
       END AS description
FROM ({_FLAGGED})"""

ORACLES["repeated_fragments"] = """
SELECT o_orderkey AS stmt_id, CAST(CASE o_orderkey % 6 WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS BIGINT) AS fragments,
       o_orderkey % 6 = 3 AS repeated FROM orders"""

ORACLES["object_access"] = """
WITH o AS (SELECT 'dag_' || CAST(o_custkey % 20 AS VARCHAR) AS dag_id, o_orderkey % 6 AS shape,
                  CAST(o_custkey AS VARCHAR) AS c, o_custkey FROM orders),
acc AS (
  SELECT dag_id, 'sales.orders_' || c AS object, true AS r FROM o WHERE shape IN (0, 2) UNION
  SELECT dag_id, 'sales.orders_v', true FROM o WHERE shape = 1 UNION
  SELECT dag_id, 'mart.daily_' || CAST(o_custkey % 7 AS VARCHAR), false FROM o WHERE shape = 2 UNION
  SELECT dag_id, 't', true FROM o WHERE shape = 3 UNION
  SELECT dag_id, 'ref.keys_' || CAST(o_custkey % 3 AS VARCHAR), true FROM o WHERE shape = 3 UNION
  SELECT dag_id, 'mart.cust_' || c, false FROM o WHERE shape = 4 UNION
  SELECT dag_id, x.object, true FROM o, (VALUES ('ops.orders'), ('ops.lines')) x(object) WHERE shape = 5)
SELECT dag_id, object, CASE WHEN bool_or(r) AND bool_or(NOT r) THEN 'read/write' WHEN bool_or(r) THEN 'read' ELSE 'write' END AS operation,
       CASE WHEN bool_and(r) THEN 'view' ELSE 'table' END AS type
FROM acc GROUP BY dag_id, object"""

_SQLW = "(?i)\\b(SELECT|WITH|INSERT|MERGE|UPDATE|DELETE|CREATE)\\b"


def _str_at(doc: str, path: str) -> str:
    return f"CASE WHEN json_type({doc}, '{path}') = 'VARCHAR' THEN json_extract_string({doc}, '{path}') END"


def _qual(x: str) -> str:
    return f"(length(trim({x})) > 20 AND regexp_matches({x}, '{_SQLW}'))"


def _salvage(x: str) -> str:
    outs = []
    for marker, endq in ((r"\'query\': \'", r"\'"), ("'query': '", "'"), ('"query": "', '"')):
        esc = "".join("\\" + ch if ch in "\\.^$|?*+()[]{}" else ch for ch in marker)
        endesc = "".join("\\" + ch if ch in "\\.^$|?*+()[]{}" else ch for ch in endq)
        t = f"regexp_extract({x}, {_q('(?s)^.*' + esc + '(.*)$')}, 1)"
        t = f"replace(replace(replace(replace(replace({t}, {_q(chr(92) * 2 + 'n')}, chr(10)), {_q(chr(92) * 2 + 't')}, chr(9)), {_q(chr(92) + chr(39))}, ''''), {_q(chr(92) + chr(34))}, '\"'), {_q(chr(92) * 2)}, {_q(chr(92))})"
        t = f"trim(regexp_replace({t}, {_q(endesc + r'\s*\.\.\.\s*$')}, ''))"
        t = f"trim(regexp_replace({t}, {_q(r'\s*\.\.\.\s*$')}, ''))"
        outs.append(f"CASE WHEN contains({x}, {_q(marker)}) AND {_qual(t)} THEN {t} END")
    return f"CASE WHEN starts_with({x}, 'Truncated') THEN coalesce({', '.join(outs)}) END"


ORACLES["json_extract"] = with_(RENDERED_JSON, f"""
leaves AS (
  SELECT r.event_id, t.id, t.key, t.path, json_extract_string(t.value, '$') AS v
  FROM rendered_json r, json_tree(r.fields) t WHERE t.type = 'VARCHAR'),
ranked AS (
  SELECT event_id, id, v,
         CASE WHEN path = '$' AND key = 'sql' THEN 0 WHEN path = '$' AND key = 'query' THEN 1
              WHEN path = '$' AND key = 'bql' THEN 2
              WHEN path = '$.configuration.query' AND key = 'query' THEN 3
              WHEN starts_with(path, '$.sql') THEN 0 WHEN starts_with(path, '$.query') THEN 1
              WHEN starts_with(path, '$.bql') THEN 2
              WHEN key = 'configuration' OR contains(path || '.', '.configuration.') THEN NULL
              ELSE 4 END AS rk
  FROM leaves),
found AS (SELECT event_id, arg_min(trim(v), (rk, id)) AS sql FROM ranked WHERE rk IS NOT NULL AND {_qual('v')}
          GROUP BY event_id),
u AS (SELECT event_id, fields,
             CASE WHEN json_type(fields, '$.rendered_fields') = 'OBJECT' THEN json_extract(fields, '$.rendered_fields')::VARCHAR
                  ELSE fields END AS uw FROM rendered_json),
x AS (
  SELECT u.event_id, f.sql,
         coalesce({', '.join(f"CASE WHEN {_qual(_str_at('u.fields', p))} THEN trim({_str_at('u.fields', p)}) END" for p in ('$.sql', '$.query', '$.bql', '$.configuration.query.query'))}) AS sql_fixed_paths,
         coalesce({', '.join(f"CASE WHEN lower(trim({_str_at('u.fields', p)})) LIKE '%.sql' THEN trim({_str_at('u.fields', p)}) END" for p in ('$.sql', '$.query', '$.bql', '$.configuration.query.query'))}) AS sql_file,
         coalesce(starts_with({_str_at('u.uw', '$.configuration')}, 'Truncated'), false) AS truncated,
         {_salvage(_str_at('u.uw', '$.configuration'))} AS salvaged
  FROM u LEFT JOIN found f USING (event_id))
""") + """
SELECT event_id, sql, sql_fixed_paths, sql_file, truncated, salvaged,
       CASE WHEN truncated AND length(coalesce(sql, '')) > 0 THEN sql
            WHEN length(coalesce(sql, '')) > 0 AND length(coalesce(salvaged, '')) > 0 THEN
                 CASE WHEN length(sql) >= length(salvaged) THEN sql ELSE salvaged END
            WHEN length(coalesce(sql, '')) > 0 THEN sql WHEN length(coalesce(salvaged, '')) > 0 THEN salvaged
            ELSE coalesce(sql, salvaged) END AS best_sql
FROM x"""

ORACLES["first_json"] = """
WITH t AS (
  SELECT event_id,
    CASE event_id % 4
      WHEN 0 THEN 'Result:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.'
      WHEN 1 THEN 'The answer is ' || props || ' as requested {not json}'
      WHEN 2 THEN 'List: [' || props || ', {"s": "a]b"}] end'
      ELSE 'no json here, value ' || CAST(value AS VARCHAR) END AS text
  FROM events),
c AS (
  SELECT event_id,
    coalesce(nullif(trim(regexp_extract(text, '```(?:json)?\\s*([\\s\\S]*?)```', 1), ' ' || chr(10)), ''),
             nullif(regexp_extract(text, '(\\{[^{}]*\\})', 1), ''),
             nullif(regexp_extract(text, '(\\[[^\\[\\]]*\\])', 1), ''), text) AS cand
  FROM t)
SELECT event_id, CASE WHEN json_valid(cand) THEN cand END AS json FROM c"""

ORACLES["json_safe"] = """
WITH e AS (SELECT event_id, value,
  CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, v, v AS sx, v AS a0, value AS a1 FROM e"""

ORACLES["prompt_cleanup"] = """
SELECT conv_id, turn,
  replace(replace(replace(replace(text, chr(160), ' '), chr(8203), ''), chr(8232), chr(10)), chr(8233), chr(10)) AS normalised,
  regexp_replace(array_to_string(list_filter(string_split(replace(text, chr(160), ' '), chr(10)),
                                             lambda l: NOT starts_with(regexp_replace(l, '^\\s+', ''), '|')), chr(10)),
                 '^\\s+|\\s+$', '', 'g') AS stripped
FROM conversations"""

_LINE_HITS = " UNION ALL ".join(
    f"SELECT path, {_q(r)} AS rule FROM dag_source_lines WHERE regexp_matches(line, {_q(p)})"
    for r, p in LINE_RULES.items())
_FILE_FLAGS = ", ".join(f"bool_or(regexp_matches(line, {_q(p)})) AS {r}" for r, p in MISSING_RULES.items())
_MISSING = " UNION ALL ".join(
    f"SELECT path, {_q(r)} AS rule, CAST(1 AS BIGINT) AS hits FROM files WHERE is_dag AND NOT {r}"
    for r in MISSING_RULES)

ORACLES["lint_sources"] = with_(DAG_SOURCE_LINES, f"""
files AS (SELECT path, bool_or(contains(line, 'from airflow') OR contains(line, 'import airflow'))
                        AND ends_with(path, '.py') AS is_dag, {_FILE_FLAGS}
          FROM dag_source_lines GROUP BY path),
hits AS ({_LINE_HITS})
""") + f"""
SELECT h.path, h.rule, count(*) AS hits FROM hits h JOIN files f ON f.path = h.path AND f.is_dag GROUP BY h.path, h.rule
UNION ALL {_MISSING}"""

ORACLES["task_formats"] = with_(TASK_INSTANCES) + """,
m AS (SELECT *, CAST(floor(date_diff('microsecond', start_date, TIMESTAMP '2024-02-01 00:00:00') / 6e7) AS BIGINT) AS mins,
             CAST(floor(duration_s) AS BIGINT) AS s FROM task_instances)
SELECT event_id,
  CASE WHEN duration_s IS NULL THEN '' WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's'
       ELSE CAST(s AS VARCHAR) || 's' END AS duration_text,
  trim(replace(replace(operator, 'Operator', ''), 'BigQuery', 'BQ')) AS operator_short,
  upper(replace(task_id, '-', '_')) AS job_name,
  CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN CAST(mins AS VARCHAR) || 'm ago'
       WHEN mins // 60 < 24 THEN CAST(mins // 60 AS VARCHAR) || 'h ago'
       ELSE CAST(mins // 60 // 24 AS VARCHAR) || 'd ago' END AS age,
  strftime(start_date, '%Y-%m-%d') AS day, strftime(start_date, '%Y-%m-%d %H:%M:%S') AS minute,
  CASE WHEN event_id % 100 >= 80 THEN 'HIGH' WHEN event_id % 100 >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band
FROM m"""

ORACLES["doc_formats"] = """
SELECT doc_id,
  CASE WHEN strlen(text) < 1024 THEN CAST(strlen(text) AS VARCHAR) || ' B'
       WHEN strlen(text) < 1048576 THEN printf('%.1f KB', round(strlen(text) / 1024.0, 1))
       ELSE printf('%.1f MB', round(strlen(text) / 1048576.0, 1)) END AS size_text,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines,
  CASE WHEN doc_id % 9 = 0 THEN 'plaintext' ELSE 'sql' END AS language,
  array_to_string(list_filter(list_transform(string_split(lang || ', ' || source || ' ,, ' || lang, ','),
                                             lambda t: trim(t)), lambda t: t <> ''), '|') AS tags,
  '/* doc ' || CAST(doc_id AS VARCHAR) || ' */' AS header,
  CAST(length(regexp_replace(text, '^\\s+', '')) AS BIGINT) AS body_chars,
  strlen(text) / 1e6 AS megabytes
FROM documents"""

# ── catalog, listings, stores ─────────────────────────────────────────────────
from .oracle_standins import DAGS, GLOSSARY, SAVED_QUERIES  # noqa: E402

ORACLES["stringify_all"] = """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
       to_json({'name': c_name, 'geo': {'nation': c_nationkey, 'segment': c_mktsegment}})::VARCHAR AS profile,
       to_json({'balance': c_acctbal})::VARCHAR AS account,
       CASE WHEN c_acctbal > 0 THEN to_json([c_mktsegment])::VARCHAR END AS tags
FROM customer"""

ORACLES["table_stats"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, "
    f"CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS column_count FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"))

_DAGLIST = """
SELECT dag_id, coalesce(nullif(schedule_interval, ''), '—') AS schedule,
       CASE WHEN NOT is_paused THEN 'active' ELSE 'paused' END AS status,
       coalesce(nullif(array_to_string(list_transform(tags, lambda t: t.name), ', '), ''), '—') AS tags,
       coalesce(nullif(regexp_extract(replace(file_loc, chr(92), '/'), '^(.*)/[^/]*$', 1), ''), '—') AS subfolder
FROM dags"""

ORACLES["list_dags"] = with_(DAGS) + _DAGLIST + """
WHERE list_contains(list_transform(tags, lambda t: t.name), 'team_1') AND contains(lower(file_loc), 'sales')"""
ORACLES["list_dags_all"] = with_(DAGS) + _DAGLIST

ORACLES["list_loaded"] = with_(REGISTRY) + """
SELECT pos, table_name, source_folder, file_path FROM registry
WHERE table_name IN (SELECT table_name FROM registry WHERE pos % 4 <> 0) AND contains(lower(source_folder), 'map')"""

ORACLES["target_of"] = _LOOKUP.replace("WITH ", "WITH " + MAPPING_CONFIG.strip() + ",", 1) + "," + _MAPLOOK + """
SELECT l.needle, coalesce(nullif(m.bq_table, ''), 'not found') AS bq_table,
       coalesce(array_to_string(m.dag_names, ','), '') AS dag_names
FROM looked l LEFT JOIN ml m USING (pos)"""

_OBJS = """
WITH o AS (
  SELECT regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*$', '') AS s, strlen(html) AS size
  FROM pages),
objs AS (SELECT regexp_extract(s, '^([^/]*)', 1) AS bucket,
                regexp_replace(regexp_extract(s, '^[^/]*/?(.*)$', 1), '^/+', '') AS path, size FROM o)"""


def _listing(prefix: str) -> str:
    lp = prefix.strip("/") + "/" if prefix.strip("/") else ""
    where = f"WHERE starts_with(path, '{lp}')" if lp else ""
    return _OBJS + f""",
r AS (SELECT bucket, substr(path, {len(lp) + 1}) AS rel, size FROM objs {where}),
n AS (SELECT bucket, CASE WHEN contains(rel, '/') THEN regexp_extract(rel, '^([^/]*)/', 1) || '/' ELSE rel END AS name,
             CASE WHEN contains(rel, '/') THEN 'dir' ELSE 'file' END AS type, size FROM r WHERE rel <> '')
SELECT bucket, name, type, CASE WHEN type = 'file' THEN CAST(sum(size) AS DOUBLE) END AS size,
       CAST(count(*) AS BIGINT) AS objects
FROM n GROUP BY bucket, name, type"""


ORACLES["folder_listing"] = _listing("")
ORACLES["folder_listing_en"] = _listing("en/")

ORACLES["split_uri"] = """
WITH s AS (SELECT page_id, url, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS s FROM pages)
SELECT page_id, regexp_extract(s, '^([^/]*)', 1) AS bucket,
       regexp_replace(regexp_extract(s, '^[^/]*(.*)$', 1), '^/+|/+$', '', 'g') AS prefix,
       regexp_extract(replace(url, chr(92), '/'), '^(.*)/[^/]*$', 1) AS subfolder
FROM s"""

ORACLES["upsert"] = """
WITH store AS (SELECT doc_id, source, 1 AS version FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0),
new AS (SELECT doc_id, upper(source) AS source, 2 AS version FROM documents WHERE doc_id % 3 = 0),
u AS (SELECT * FROM store UNION ALL SELECT * FROM new)
SELECT doc_id, source, version FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1"""

ORACLES["last_wins"] = """
SELECT source, doc_id, lang, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1"""

ORACLES["cap_history"] = """
SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 500"""

ORACLES["search_queries"] = with_(SAVED_QUERIES) + """
SELECT id, name, source, description FROM saved_queries
WHERE source = 'assistant' AND (contains(lower(name), 'turn 2') OR contains(lower(sql), 'turn 2')
   OR contains(lower(coalesce(description, '')), 'turn 2') OR len(list_filter(tags, lambda t: contains(t, 'turn 2'))) > 0)"""

ORACLES["search_tags"] = with_(SAVED_QUERIES) + """
SELECT id, name, source FROM saved_queries
WHERE contains(lower(name), 'ang_1') OR contains(lower(sql), 'ang_1') OR contains(lower(coalesce(description, '')), 'ang_1')
   OR len(list_filter(tags, lambda t: contains(t, 'ang_1'))) > 0"""

# term by term in glossary order over every text: word boundaries as classes (RE2's are ASCII only)
ORACLES["expand_glossary"] = with_(GLOSSARY).replace("WITH ", "WITH RECURSIVE ", 1) + r"""
, steps AS (SELECT row_number() OVER (ORDER BY pos) AS i, term, definition FROM glossary),
fold(conv_id, turn, i, t) AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT), text FROM conversations
  UNION ALL
  SELECT f.conv_id, f.turn, s.i,
         regexp_replace(f.t, '(?i)(^|[^\pL\pN_])' || regexp_escape(s.term) || '($|[^\pL\pN_])',
                        '\1' || s.term || ' (' || replace(coalesce(s.definition, ''), '\', '\\') || ')\2')
  FROM fold f JOIN steps s ON s.i = f.i + 1)
SELECT conv_id, turn, t AS expanded FROM fold WHERE i = (SELECT count(*) FROM steps)"""

ORACLES["search_glossary"] = with_(GLOSSARY) + """
SELECT term, pos, definition FROM glossary WHERE contains(lower(term), 'th') OR contains(lower(definition), 'th')"""

ORACLES["health_windows"] = with_(TASK_INSTANCES) + f"""
SELECT date_trunc('day', start_date) AS window_start, date_trunc('day', start_date) + INTERVAL 1 DAY AS window_end,
       dag_id, task_id, count(*) AS instances, count(duration_s) AS runs,
       CASE WHEN count(duration_s) > 0 THEN {_exact_avg('duration_s', 'count(duration_s)', 2)} END AS avg_duration_s,
       {_exact_rate(_OK, 'count(*)', 3)} AS success_rate,
       CASE WHEN count(duration_s) = 0 THEN NULL ELSE {_health('duration_s', 'count(duration_s)', _OK, 'count(*)')} END
         AS health_status
FROM task_instances GROUP BY ALL"""

# ── composites and set operations ─────────────────────────────────────────────
from .oracle_standins import RENDERED_INSTANCES  # noqa: E402

_LATEST_SQL = with_(DAG_RUNS, TASK_DEFS, GRAPH_INSTANCES, RENDERED_INSTANCES, """
ok AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY logical_date DESC, run_key DESC) AS rc
  FROM dag_runs WHERE state = 'success') WHERE rc <= 10),
inst AS (SELECT dag_id, run_id, task_id, rendered_sql FROM rendered_instances
         WHERE (dag_id, run_id) IN (SELECT (dag_id, run_id) FROM ok)
         QUALIFY row_number() OVER (PARTITION BY dag_id, run_id, task_id
                                    ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC) = 1),
lts AS (SELECT i.dag_id, i.task_id, i.run_id, i.rendered_sql FROM inst i JOIN ok o USING (dag_id, run_id)
        WHERE length(trim(coalesce(i.rendered_sql, ''))) > 0
        QUALIFY row_number() OVER (PARTITION BY i.dag_id, i.task_id ORDER BY o.logical_date DESC, o.run_key DESC) = 1)
""")

ORACLES["latest_task_sql"] = _LATEST_SQL + "SELECT dag_id, task_id, run_id, rendered_sql FROM lts"

ORACLES["task_sql"] = _LATEST_SQL + """
SELECT t.dag_id, t.task_id, t.sql AS raw_sql, l.run_id, l.rendered_sql,
       CASE WHEN length(coalesce(t.sql, '')) > 0 AND length(coalesce(l.rendered_sql, '')) > 0 THEN
              CASE WHEN length(t.sql) >= length(l.rendered_sql) THEN t.sql ELSE l.rendered_sql END
            WHEN length(coalesce(t.sql, '')) > 0 THEN t.sql
            WHEN length(coalesce(l.rendered_sql, '')) > 0 THEN l.rendered_sql
            ELSE coalesce(t.sql, l.rendered_sql) END AS best_sql
FROM task_defs t LEFT JOIN lts l USING (dag_id, task_id)"""

ORACLES["trace_sql"] = _LATEST_SQL.rstrip() + ", " + _TRACE.split("firsts AS (")[0].split("WITH ", 1)[1].split(
    GRAPH_INSTANCES)[1].lstrip(",") + "firsts AS (" + _TRACE.split("firsts AS (")[1].split("recent AS (")[0].rstrip().rstrip(",") + """
SELECT p.needle, p.dag_id, t.task_id,
       CASE WHEN length(coalesce(l.rendered_sql, '')) > length(t.sql) THEN l.rendered_sql ELSE t.sql END AS best_sql
FROM per_dag p JOIN task_defs t USING (dag_id) LEFT JOIN lts l USING (dag_id, task_id) WHERE t.sql IS NOT NULL"""

# which SQL each loading task has is known from how the stand-ins make it
ORACLES["task_sql_files"] = with_(DAG_RUNS, """
ok AS (SELECT run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY logical_date DESC, run_key DESC) AS rc
  FROM dag_runs WHERE state = 'success') WHERE rc <= 10),
t AS (
  SELECT 'dag_' || CAST(o_custkey % 20 AS VARCHAR) AS dag_id, 'load_' || CAST(o_orderkey AS VARCHAR) AS task_id,
         CASE WHEN o_orderkey % 16 = 0 THEN 'SELECT file_col FROM root1.t_' || CAST(o_orderkey AS VARCHAR)
              WHEN o_orderkey % 8 = 0 THEN 'SELECT file_col FROM root2.t_' || CAST(o_orderkey AS VARCHAR)
              WHEN o_orderkey % 4 = 1 THEN 'SELECT a, b FROM ds.top_' || CAST(o_orderkey AS VARCHAR)
              WHEN o_orderkey % 4 = 2 THEN 'SELECT c FROM ds.job_' || CAST(o_orderkey AS VARCHAR) END AS raw_sql,
         o.run_id, o_orderkey % 3 = 0 AS cut,
         CASE WHEN o.run_id IS NULL THEN NULL
              WHEN o_orderkey % 3 = 0 THEN 'SELECT cut_col, another_one FROM ds.cut_' || CAST(o_orderkey AS VARCHAR)
              WHEN o_orderkey % 3 = 1 THEN 'SELECT a, b, rendered_column FROM ds.rendered_' || CAST(o_orderkey AS VARCHAR)
         END AS rendered_sql
  FROM orders LEFT JOIN ok o ON o.run_id = 'run_' || CAST(o_orderkey AS VARCHAR))
""") + """
SELECT dag_id, task_id, raw_sql, CASE WHEN rendered_sql IS NOT NULL THEN run_id END AS run_id, rendered_sql,
       CASE WHEN raw_sql IS NULL THEN rendered_sql WHEN rendered_sql IS NULL OR cut THEN raw_sql
            WHEN length(raw_sql) >= length(rendered_sql) THEN raw_sql ELSE rendered_sql END AS best_sql
FROM t"""

ORACLES["error_report"] = with_(TASK_INSTANCES, TASK_LOGS, """
ff AS (SELECT dag_id, run_id, task_id, state, position FROM (
  SELECT *, row_number() OVER (PARTITION BY dag_id, run_id ORDER BY event_id) AS position
  FROM task_instances WHERE state IN ('failed', 'upstream_failed')) WHERE position <= 5
  QUALIFY row_number() OVER (PARTITION BY dag_id, run_id, task_id ORDER BY position) = 1),
tl AS (SELECT * FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.dag_id, l.run_id, l.task_id ORDER BY l.line_no DESC) AS r
  FROM task_logs l WHERE (dag_id, run_id, task_id) IN (SELECT (dag_id, run_id, task_id) FROM ff)) WHERE r <= 50)
""") + """
SELECT f.dag_id, f.run_id, f.task_id, f.state, f.position, t.line_no, t.line,
       contains(t.line, 'ERROR') OR contains(t.line, 'Traceback') OR contains(t.line, 'Exception') AS is_error
FROM ff f JOIN tl t USING (dag_id, run_id, task_id)"""

ORACLES["execution_log_runs"] = _HIST.replace("WHERE recency <= 10", "WHERE recency <= 20") + "SELECT * FROM hist"

ORACLES["reconcile_overrides"] = _RECON_BASE.replace(
    f"c AS (SELECT {norm_name('raw_name')} AS logical_name,",
    f"c AS (SELECT CASE WHEN raw_name LIKE '%\\_v3.sql' ESCAPE '\\' THEN {norm_name('raw_name')} || '_legacy' "
    f"ELSE {norm_name('raw_name')} END AS logical_name,") + "SELECT * FROM f"

ORACLES["only_in_git"] = with_(GIT_FILES, GCS_FILES) + """
SELECT substr(path, 5) AS rel_path FROM git_files
WHERE substr(path, 5) NOT IN (SELECT substr(path, 5) FROM gcs_files)"""

ORACLES["common_files"] = with_(GIT_FILES, GCS_FILES) + """
SELECT substr(path, 5) AS rel_path FROM git_files
WHERE substr(path, 5) IN (SELECT substr(path, 5) FROM gcs_files)"""

ORACLES["name_universe"] = with_(GIT_FILES, GCS_FILES, MAPPING) + f"""
SELECT {norm_name('raw_name')} AS logical_name FROM git_files
UNION SELECT {norm_name('raw_name')} FROM gcs_files UNION SELECT {norm_name('raw_name')} FROM mapping"""

ORACLES["preview"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500"

ORACLES["flag_counts"] = "SELECT flag_type, count(*) AS n, CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS high_impact FROM (" \
    + ORACLES["sql_flags"] + ") x GROUP BY flag_type"

ORACLES["asof_orders"] = DELEGATED["sql_d5_asof"][2]
ORACLES["windows_orders"] = DELEGATED["sql_d8_windows"][2]

ORACLES["task_performance_recent"] = ORACLES["task_performance"].replace(
    "FROM task_instances GROUP BY dag_id, task_id HAVING", "FROM tir GROUP BY dag_id, task_id HAVING").replace(
    "FROM task_instances WHERE duration_s IS NOT NULL", "FROM tir WHERE duration_s IS NOT NULL").replace(
    "\nstats AS (", """
newest AS (SELECT dag_id, run_id FROM (
  SELECT dag_id, run_id, row_number() OVER (PARTITION BY dag_id ORDER BY CAST(min(start_date) AS DATE) DESC) AS r
  FROM task_instances GROUP BY dag_id, run_id) WHERE r <= 10),
tir AS (SELECT * FROM task_instances WHERE (dag_id, run_id) IN (SELECT (dag_id, run_id) FROM newest)),
stats AS (""", 1)

ORACLES["task_depth_recursive"] = "WITH RECURSIVE " + DAG_RUNS.strip() + "," + TASK_DEFS.strip() + """,
te AS (SELECT dag_id, task_id AS src, unnest(downstream_task_ids) AS dst FROM task_defs),
walk(dag_id, task_id, depth) AS (
  SELECT dag_id, task_id, 0 FROM task_defs t
  WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.dag_id = t.dag_id AND te.dst = t.task_id)
  UNION ALL
  SELECT te.dag_id, te.dst, w.depth + 1 FROM walk w JOIN te ON te.dag_id = w.dag_id AND te.src = w.task_id)
SELECT dag_id, task_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY dag_id, task_id"""

ORACLES["dags_of"] = _LOOKUP.replace("WITH ", "WITH " + MAPPING_CONFIG.strip() + ",", 1) + "," + _MAPLOOK + """
SELECT l.needle, CAST(u.i - 1 AS BIGINT) AS pos, u.dag_id
FROM looked l JOIN ml m USING (pos), unnest(m.dag_names) WITH ORDINALITY u(dag_id, i)"""

ORACLES["task_table"] = "SELECT dag_id, task_id AS task, replace(operator, 'Operator', '') AS operator, coalesce(nullif(state, ''), '—') AS state, " \
    "CASE WHEN coalesce(duration_s, 0) = 0 THEN '—' ELSE printf('%.1f', round_even(duration_s, 1)) END AS duration, " \
    "CASE WHEN coalesce(try_number, 0) > 0 THEN CAST(CAST(try_number AS BIGINT) AS VARCHAR) ELSE '—' END AS try, " \
    "coalesce(nullif(downstream, ''), '—') AS depends_on FROM (" + ORACLES["task_graph"] + ")"

ORACLES["schema_ddl_arrays"] = "SELECT batch, table_name, '[' || string_agg('{\"name\":\"' || name || '\",\"type\":\"' || type || " \
    "'\",\"mode\":\"' || mode || '\"}', ',' ORDER BY position) || ']' AS fields FROM (" + ORACLES["schema_ddl"] + ") GROUP BY batch, table_name"

ORACLES["ago_text"] = """
WITH e AS (SELECT event_id, event_id % 4 AS shape,
                  CAST(floor(date_diff('microsecond', date_trunc('second', ts), TIMESTAMP '2024-02-01 00:00:00') / 6e7) AS BIGINT) AS mins
           FROM events)
SELECT event_id, CASE WHEN shape = 0 THEN 'not a time' WHEN shape = 1 THEN '' WHEN mins < 1 THEN 'just now'
  WHEN mins < 60 THEN CAST(mins AS VARCHAR) || 'm ago' WHEN mins // 60 < 24 THEN CAST(mins // 60 AS VARCHAR) || 'h ago'
  ELSE CAST(mins // 60 // 24 AS VARCHAR) || 'd ago' END AS age FROM e"""
