"""Catalog, registry and listing jobs.

Listings are DataFrames of paths; one level of a folder is a group-by on the next path
segment, so a prefix with millions of objects is rolled up in parallel.
"""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from ..functions.names import quoted, subfolder
from .lineage import lookup_first, mapping_lookup


def stringify_all(df: DataFrame) -> DataFrame:
    """S3: every column to string; nested values as JSON, binary as base64."""
    cols = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (StructType, ArrayType, MapType)):
            cols.append(F.to_json(c).alias(f.name))
        elif isinstance(f.dataType, BinaryType):
            cols.append(F.base64(c).alias(f.name))
        else:
            cols.append(c.cast("string").alias(f.name))
    return df.select(cols)


def register(df: DataFrame, name: str) -> DataFrame:
    """Publish as a queryable view (session scope)."""
    df.createOrReplaceTempView(name)
    return df


def table_stats(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Per table, row count and column count/types — one aggregate per table, unioned
    into a single job (no driver loop over rows)."""
    parts = []
    for name, df in tables.items():
        types = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.col("row_count").cast("long"),
            F.lit(len(df.columns)).cast("long").alias("column_count"), F.lit(types).alias("column_types")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Q19: tables and views of the session catalog with their row counts."""
    listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    frames = {t.name: spark.table(t.name if not t.database else f"{t.database}.{t.name}") for t in listed}
    if not frames:
        return spark.createDataFrame([], "table_name string, row_count long, column_count long, column_types string")
    kinds = spark.createDataFrame([(t.name, t.tableType, t.isTemporary) for t in listed],
                                  "table_name string, table_type string, is_temporary boolean")
    return table_stats(spark, frames).join(kinds, "table_name")


def databases(spark: SparkSession) -> DataFrame:
    """Q19: the databases of the session's catalog."""
    return spark.createDataFrame([(d.name, d.description, d.locationUri) for d in spark.catalog.listDatabases()],
                                 "database string, description string, location string")


def table_metadata(spark: SparkSession, in_databases: Sequence[str] | None = None) -> DataFrame:
    """Q19: ``database, table_name, table_type, provider, created, modified, files, size_bytes, row_count,
    column_count, column_types`` of every registered table and view (temporary ones have no database).

    Type and creation come from the catalog, one description per table; files, sizes and last changes from one
    distributed listing of all tables' folders (null for views); row counts from one job over all tables."""
    names = [d.name for d in spark.catalog.listDatabases()] if in_databases is None else list(in_databases)
    told, frames = {}, {}
    for db in names:
        for t in spark.catalog.listTables(db):
            ident = quoted(t.name) if t.isTemporary else f"{quoted(db)}.{quoted(t.name)}"
            if ident not in told:
                about = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {ident} AS JSON").first()[0])
                place = about.get("location")
                told[ident] = (ident, None if t.isTemporary else db, t.name, t.tableType, about.get("provider"), about.get("created_time"),
                               None if place is None else place.rstrip("/"))
                frames[ident] = spark.table(ident)
    schema = "ident string, database string, table_name string, table_type string, provider string, created_at string, location string"
    out = spark.createDataFrame([*told.values()], schema)
    places = sorted({r[-1] for r in told.values() if r[-1]})
    if places:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places)
        steps = F.split(F.regexp_replace("path", "^(file:)//(?=/)", "$1"), "/")
        above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
        sizes = (files.select("length", "modificationTime", F.explode(above).alias("location"))
                 .join(F.broadcast(out.where("location is not null").select("location").distinct()), "location")  # a row per table
                 .groupBy("location").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("size_bytes"),
                                          F.max("modificationTime").alias("modified")))
        out = out.join(sizes, "location", "left")
    else:
        out = out.select("*", F.lit(None).cast("long").alias("files"), F.lit(None).cast("long").alias("size_bytes"),
                         F.lit(None).cast("timestamp").alias("modified"))
    here = F.col("location").isNotNull()
    if not frames:
        stats = spark.createDataFrame([], "ident string, row_count long, column_count long, column_types string")
    else:
        stats = table_stats(spark, frames).withColumnRenamed("table_name", "ident")
    return out.join(stats, "ident", "left").select(
        "database", "table_name", "table_type", "provider", F.to_timestamp("created_at").alias("created"), "modified",
        F.when(here, F.coalesce("files", F.lit(0))).alias("files"), F.when(here, F.coalesce("size_bytes", F.lit(0))).alias("size_bytes"),
        "row_count", "column_count", "column_types")


def filter_contains(df: DataFrame, col: str, needle: str | None) -> DataFrame:
    """Case-insensitive substring filter; no needle → all rows."""
    if not needle:
        return df
    return df.where(F.lower(F.coalesce(F.col(col), F.lit(""))).contains(needle.lower()))


def filter_tag(df: DataFrame, tag: str | None, tags: str = "tags") -> DataFrame:
    """Exact membership in the list of tag names (tags is array<struct<name>>)."""
    if not tag:
        return df
    return df.where(F.array_contains(F.transform(F.col(tags), lambda t: t["name"]), tag))


def list_dags(dags: DataFrame, tag: str | None = None, subfolder_filter: str | None = None) -> DataFrame:
    """Q18: DAGs with schedule, active flag, tag names and the sub-folder of their file."""
    d = filter_tag(dags, tag)
    loc = F.coalesce(F.col("file_loc"), F.lit(""))
    if subfolder_filter:
        d = d.where(F.lower(loc).contains(subfolder_filter.lower()))
    return project_dag_list(d.select(
        "dag_id", F.col("schedule_interval").alias("schedule"), (~F.col("is_paused")).alias("active"),
        F.transform("tags", lambda t: t["name"]).alias("tag_names"), subfolder(loc).alias("subfolder")))


def project_dag_list(d: DataFrame) -> DataFrame:
    """Display projection — arrays joined with ', ', null/empty → '—', paused label."""
    dash = F.lit("—")
    return d.select(
        "dag_id", F.coalesce(F.nullif(F.col("schedule"), F.lit("")), dash).alias("schedule"),
        F.when(F.col("active"), "active").otherwise("paused").alias("status"),
        F.coalesce(F.nullif(F.array_join("tag_names", ", "), F.lit("")), dash).alias("tags"),
        F.coalesce(F.nullif(F.col("subfolder"), F.lit("")), dash).alias("subfolder"))


def list_loaded(registry: DataFrame, active: DataFrame | None = None, folder_filter: str | None = None) -> DataFrame:
    """Registry entries whose table is currently registered (left semi), optionally
    filtered by folder (case-insensitive substring)."""
    r = registry if active is None else registry.join(active.select("table_name"), "table_name", "left_semi")
    return filter_contains(r, "source_folder", folder_filter)


def target_of(registry: DataFrame, config: DataFrame, needles: DataFrame) -> DataFrame:
    """Q17: the target table for each mapping-file name (first registry match), 'not found'
    when nothing matches or no target is configured."""
    hit = lookup_first(registry, needles)
    found = mapping_lookup(hit.where(F.col("pos").isNotNull()), config)
    none = hit.where(F.col("pos").isNull()).select("needle", F.lit(None).cast("string").alias("bq_table"),
                                                    F.array().cast("array<string>").alias("dag_names"))
    both = found.select("needle", "bq_table", "dag_names").unionByName(none)
    return both.select("needle", F.coalesce(F.nullif("bq_table", F.lit("")), F.lit("not found")).alias("bq_table"),
                       F.coalesce("dag_names", F.array().cast("array<string>")).alias("dag_names"))


def dags_of(registry: DataFrame, config: DataFrame, needles: DataFrame) -> DataFrame:
    """Q17: the DAGs of each mapping-file name (first registry match), one row per DAG in the order of
    the mapping; a name without a match or without DAGs has no row."""
    return target_of(registry, config, needles).select("needle", F.posexplode("dag_names").alias("pos", "dag_id")) \
        .withColumn("pos", F.col("pos").cast("long"))


def table_schema(spark: SparkSession, name: str) -> DataFrame:
    """Q17: the columns of a registered table with their types, in order; no rows for an unknown table."""
    fields = spark.table(name).schema.fields if spark.catalog.tableExists(name) else []
    rows = [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position long, column_name string, column_type string")


def project_task_table(graph: DataFrame) -> DataFrame:
    """Display projection of a task graph — operator without its suffix, one decimal, '—' for what
    is missing, empty or zero."""
    dash = F.lit("—")
    shown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), dash)
    return graph.select(
        "dag_id", F.col("task_id").alias("task"), F.replace("operator", F.lit("Operator"), F.lit("")).alias("operator"),
        shown("state").alias("state"),
        F.when(F.col("duration_s") != 0, F.format_string("%.1f", F.bround(F.col("duration_s").cast("decimal(38,6)"), 1)
                                                         .cast("double"))).otherwise(dash).alias("duration"),
        F.when(F.col("try_number") > 0, F.col("try_number").cast("long").cast("string")).otherwise(dash).alias("try"),
        shown("downstream").alias("depends_on"))


# ── listings (Q22) ─────────────────────────────────────────────────────────────

def object_paths(urls: DataFrame, url: str = "url", size: str | None = None) -> DataFrame:
    """Object URIs → (bucket, path, size): scheme dropped, host is the bucket, query and
    fragment dropped."""
    s = F.regexp_replace(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    s = F.regexp_replace(s, r"[?#].*$", "")
    return urls.select(F.regexp_extract(s, r"^([^/]*)", 1).alias("bucket"),
                       F.regexp_replace(F.regexp_extract(s, r"^[^/]*/?(.*)$", 1), r"^/+", "").alias("path"),
                       (F.col(size).cast("long") if size else F.lit(None).cast("long")).alias("size"))


def folder_listing(objects: DataFrame, prefix: str = "", by: Sequence[str] = ("bucket",)) -> DataFrame:
    """One level under ``prefix``: files directly in it (with size) and sub-folders rolled
    up (object count and total size).  Order: folders first, then name case-insensitively."""
    p = prefix.strip("/")
    lp = p + "/" if p else ""
    o = objects.where(F.col("path").startswith(lp)) if lp else objects
    rel = F.substring(F.col("path"), len(lp) + 1, 1 << 30)
    o = o.select(*by, rel.alias("rel"), "size").where(F.col("rel") != "")
    is_dir = F.col("rel").contains("/")
    name = F.when(is_dir, F.concat(F.regexp_extract("rel", r"^([^/]*)/", 1), F.lit("/"))).otherwise(F.col("rel"))
    g = (o.select(*by, name.alias("name"), F.when(is_dir, "dir").otherwise("file").alias("type"), "size")
         .groupBy(*by, "name", "type")
         .agg(F.count(F.lit(1)).cast("long").alias("objects"), F.sum("size").cast("double").alias("size")))
    return g.select(*by, "name", "type", F.when(F.col("type") == "file", F.col("size")).alias("size"),
                    "objects").orderBy(*by, F.col("type") != "dir", F.lower("name"), "name")
