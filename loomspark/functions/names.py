"""Name, path and label normalisation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip_underscores(c: Column) -> Column:
    return F.regexp_replace(c, r"^_+|_+$", "")


def safe_table_name(folder, stem) -> Column:
    """lower('folder_stem'), characters outside [a-z0-9_] → '_', runs collapsed, '_' trimmed."""
    name = F.lower(F.concat(_c(folder), F.lit("_"), _c(stem)))
    name = F.regexp_replace(name, r"[^a-z0-9_]", "_")
    name = F.regexp_replace(name, r"_+", "_")
    return _strip_underscores(name)


def path_name(path) -> Column:
    """Last path component (trailing slashes ignored), like a path's name."""
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def path_stem(path) -> Column:
    """Name without its last suffix; a leading-dot name or a trailing dot keeps everything."""
    return F.regexp_replace(path_name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def path_suffix(path) -> Column:
    return F.regexp_extract(path_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def normalise_name(raw, override=None) -> Column:
    """Logical name of a file: override wins; else stem, lower, non-alnum → '_',
    collapse, strip a trailing ``_v<digits>`` and then trim '_'."""
    n = F.lower(path_stem(raw))
    n = F.regexp_replace(n, r"[^a-z0-9]", "_")
    n = F.regexp_replace(n, r"_+", "_")
    n = F.regexp_replace(n, r"_v[0-9]+$", "")
    n = _strip_underscores(n)
    return n if override is None else F.coalesce(_c(override), n)


def subfolder(file_loc) -> Column:
    """Backslashes to '/', drop the last segment; '' when there is only one segment."""
    p = F.regexp_replace(F.coalesce(_c(file_loc), F.lit("")), r"\\", "/")
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def job_name(c) -> Column:
    return F.upper(F.replace(_c(c), F.lit("-"), F.lit("_")))


# fixed values: operator-name shortening (removed word, replaced word and replacement)
OPERATOR_WORD, BIGQUERY_WORD, BIGQUERY_SHORT = "Operator", "BigQuery", "BQ"


def short_operator(c) -> Column:
    """Drop 'Operator', 'BigQuery' → 'BQ', then trim."""
    s = F.replace(_c(c), F.lit(OPERATOR_WORD), F.lit(""))
    s = F.replace(s, F.lit(BIGQUERY_WORD), F.lit(BIGQUERY_SHORT))
    return F.trim(s)


# fixed values: file suffix → editor language
FILE_LANGUAGES = {
    ".py": "python", ".sql": "sql", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".sh": "shell", ".bash": "shell", ".md": "markdown", ".txt": "plaintext",
    ".csv": "plaintext", ".xml": "xml", ".html": "html", ".js": "javascript",
    ".ts": "typescript",
}


def file_language(path) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FILE_LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(path_suffix(path))), F.lit("plaintext"))


def split_tags(c) -> Column:
    """Comma split, trim each, drop empties."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def split_object_uri(c) -> Column:
    """(bucket, prefix) of an object URI: optional scheme, host/bucket, path trimmed of '/'."""
    s = F.regexp_replace(_c(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    bucket = F.regexp_extract(s, r"^([^/]*)", 1)
    prefix = F.regexp_replace(F.regexp_extract(s, r"^[^/]*(.*)$", 1), r"^/+|/+$", "")
    return F.struct(bucket.alias("bucket"), prefix.alias("prefix"))


def quoted(name: str) -> str:
    """A column name as it must be written in expressions, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"
