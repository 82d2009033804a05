"""Column expressions. Every function takes and returns ``pyspark.sql.Column``
(JVM-side built-ins only, so they stay inside whole-stage codegen)."""
from .names import (safe_table_name, normalise_name, path_stem, path_name, subfolder,
                    job_name, short_operator, file_language, split_tags, split_object_uri)
from .timefmt import duration_seconds, fmt_duration, fmt_ago, fmt_size, iso_date, iso_minute
from .types import source_to_target_type, canonical_type, audit_status, health_status, confidence_band

__all__ = ["safe_table_name", "normalise_name", "path_stem", "path_name", "subfolder", "job_name",
           "short_operator", "file_language", "split_tags", "split_object_uri", "duration_seconds",
           "fmt_duration", "fmt_ago", "fmt_size", "iso_date", "iso_minute", "source_to_target_type",
           "canonical_type", "audit_status", "health_status", "confidence_band"]
