"""Type mapping and status rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: source (MySQL) base type → expected warehouse type
SOURCE_TO_TARGET = {
    "int": "INT64", "bigint": "INT64", "smallint": "INT64", "tinyint": "INT64", "mediumint": "INT64",
    "float": "FLOAT64", "double": "FLOAT64",
    "decimal": "NUMERIC",
    "varchar": "STRING", "char": "STRING", "text": "STRING", "longtext": "STRING",
    "mediumtext": "STRING", "tinytext": "STRING",
    "datetime": "DATETIME", "timestamp": "TIMESTAMP", "date": "DATE", "time": "TIME",
    "boolean": "BOOL", "bool": "BOOL", "bit": "BOOL",
    "json": "JSON",
    "blob": "BYTES", "longblob": "BYTES", "mediumblob": "BYTES",
}

# fixed values: warehouse type aliases → canonical name
TARGET_ALIASES = {
    "INTEGER": "INT64", "INT": "INT64", "SMALLINT": "INT64", "BIGINT": "INT64",
    "BYTEINT": "INT64", "TINYINT": "INT64",
    "FLOAT": "FLOAT64",
    "DECIMAL": "NUMERIC", "BIGDECIMAL": "NUMERIC", "BIGNUMERIC": "NUMERIC",
    "BOOLEAN": "BOOL",
}

# fixed values: audit status labels
MATCH, TYPE_MISMATCH, TARGET_ONLY, SOURCE_ONLY = "Match", "Type Mismatch", "Target Only", "Source Only"
AUDIT_STATUSES = (MATCH, TYPE_MISMATCH, TARGET_ONLY, SOURCE_ONLY)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def source_to_target_type(t) -> Column:
    """Trimmed lower-case lookup; unknown → trimmed upper-case itself. No length-suffix
    stripping, so 'varchar(20)' is unknown. Empty/null source type → ''."""
    tt = F.trim(_c(t))
    mapped = F.coalesce(F.element_at(_lookup(SOURCE_TO_TARGET), F.lower(tt)), F.upper(tt))
    return F.when(F.coalesce(tt, F.lit("")) == "", F.lit("")).otherwise(mapped)


def canonical_type(t) -> Column:
    u = F.upper(F.trim(_c(t)))
    return F.coalesce(F.element_at(_lookup(TARGET_ALIASES), u), u)


def audit_status(in_source, in_target, expected, actual) -> Column:
    """No source row → Target Only; no target row → Source Only; both types non-empty
    and canonical forms differ → Type Mismatch; else Match."""
    e, a = F.coalesce(_c(expected), F.lit("")), F.coalesce(_c(actual), F.lit(""))
    return (F.when(~_c(in_source), F.lit(TARGET_ONLY))
            .when(~_c(in_target), F.lit(SOURCE_ONLY))
            .when((e != "") & (a != "") & (canonical_type(a) != canonical_type(e)), F.lit(TYPE_MISMATCH))
            .otherwise(F.lit(MATCH)))


# fixed values: default health thresholds
DEFAULT_THRESHOLDS = {
    "task_warning_seconds": 300.0,
    "task_critical_seconds": 600.0,
    "success_rate_warning": 0.9,
    "success_rate_critical": 0.7,
}


def health_status(avg_s, rate, thresholds: dict | None = None) -> Column:
    """critical: avg ≥ critical seconds or rate < critical rate; warning likewise; else healthy.
    Applied to the unrounded average and rate."""
    t = dict(DEFAULT_THRESHOLDS)
    t.update(thresholds or {})
    a, r = _c(avg_s), _c(rate)
    return (F.when((a >= F.lit(float(t["task_critical_seconds"])))
                   | (r < F.lit(float(t["success_rate_critical"]))), F.lit("critical"))
            .when((a >= F.lit(float(t["task_warning_seconds"])))
                  | (r < F.lit(float(t["success_rate_warning"]))), F.lit("warning"))
            .otherwise(F.lit("healthy")))


def health_status_exact(dur_sum, runs, ok, n, thresholds: dict | None = None) -> Column:
    """``health_status`` on exact totals: avg ≥ t ⇔ sum ≥ t·runs and rate < r ⇔ ok < r·n,
    so a decimal average sitting exactly on a threshold is classified exactly."""
    from decimal import Decimal
    t = dict(DEFAULT_THRESHOLDS)
    t.update(thresholds or {})
    d = lambda x: F.lit(Decimal(str(x)))
    s, r, k, m = _c(dur_sum), _c(runs), _c(ok), _c(n)
    crit = (s >= d(t["task_critical_seconds"]) * r) | (k < d(t["success_rate_critical"]) * m)
    warn = (s >= d(t["task_warning_seconds"]) * r) | (k < d(t["success_rate_warning"]) * m)
    return F.when(crit, F.lit("critical")).when(warn, F.lit("warning")).otherwise(F.lit("healthy"))


# fixed values: health severity order for the roll-up
HEALTH_SEVERITY = {"healthy": 0, "warning": 1, "critical": 2}


def confidence_band(score) -> Column:
    s = _c(score)
    return F.when(s >= 80, "HIGH").when(s >= 50, "MEDIUM").otherwise("LOW")
