"""Small user stores as tables: upserts, newest-per-key, capped history, searches and
the audit log (A15, K6, K8, W8, P11, P12, F35, U5).

A store is a versioned folder of Parquet: an upsert reads the current version and
writes the next one, never overwriting a path that is being read.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reconcile import last_wins  # noqa: F401  (A15 lives with the reconcile job)


def upsert(store: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """K8: add or replace by key — the row with the greatest ``order`` per key wins."""
    return last_wins(store.unionByName(new, allowMissingColumns=True), keys, order)


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """U5/K8 (queries, favourites): bag union; a missing id or timestamp is filled in."""
    n = new
    if "id" in store.columns:
        n = n.withColumn("id", F.coalesce(F.col("id"), F.expr("uuid()"))) if "id" in n.columns \
            else n.withColumn("id", F.expr("uuid()"))
    if "created_at" in store.columns:
        n = n.withColumn("created_at", F.coalesce(F.col("created_at"), F.current_timestamp())) \
            if "created_at" in n.columns else n.withColumn("created_at", F.current_timestamp())
    return store.unionByName(n, allowMissingColumns=True)


def cap_history(df: DataFrame, n: int = 500, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Keep the newest ``n`` entries (the cap is the feature)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def search_queries(df: DataFrame, text: str | None = None, source: str | None = None) -> DataFrame:
    """Source equality; text (case-insensitive) in name, sql or description, or as a
    substring of any tag (tags compared as stored)."""
    d = df
    if source:
        d = d.where(F.col("source") == source)
    if text:
        t = text.lower()
        cond = (F.lower(F.coalesce("name", F.lit(""))).contains(t)
                | F.lower(F.coalesce("sql", F.lit(""))).contains(t)
                | F.lower(F.coalesce("description", F.lit(""))).contains(t)
                | F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda x: x.contains(t)))
        d = d.where(cond)
    return d


def search_glossary(df: DataFrame, text: str | None) -> DataFrame:
    """Text in term or definition (case-insensitive)."""
    if not text:
        return df
    t = text.lower()
    return df.where(F.lower("term").contains(t) | F.lower(F.coalesce("definition", F.lit(""))).contains(t))


def audit_record(df: DataFrame, module: str, source: str, query: str, duration_ms: int | None = None,
                 user_action: str | None = None) -> DataFrame:
    """K6: one audit row for an operation over ``df`` (its row count is one aggregate)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.current_timestamp().alias("timestamp"), F.lit(module).alias("module"), F.lit(source).alias("source"),
        F.lit(query).alias("query"), F.col("row_count").cast("long"),
        F.lit(duration_ms).cast("long").alias("duration_ms"), F.lit(user_action).alias("user_action"))
