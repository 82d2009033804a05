"""Readers for landed files: object listings, source trees, code, logs, JSON payloads,
small JSON stores and the mapping config (S1, S6–S12, S14, T1).

Listings use the ``binaryFile`` source and select only path/length/modificationTime, so
Spark never reads file bodies for a listing; bodies are read only where content is
needed (hashes, code scans).
"""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, MapType, StringType,
                               StructField, StructType)

from ..functions.names import path_name, path_stem


def _strip_scheme(c):
    """The path of a listing without the scheme; paths of the ``binaryFile`` source are not URL-encoded."""
    return F.regexp_replace(c, r"^file:(?://(?=/))?", "")


def _input_file():
    """The file a row was read from, in the form of listings: ``input_file_name`` is URL-encoded."""
    return _strip_scheme(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))))


def list_objects(spark: SparkSession, root: str, glob: str | None = None, with_md5: bool = False) -> DataFrame:
    """Every file under ``root`` (recursive) with name, size and modification time;
    ``with_md5`` adds a checksum (this reads the bodies)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    cols = [_strip_scheme(F.col("path")).alias("path"), path_name(F.col("path")).alias("name"),
            F.col("length").alias("size"), F.col("modificationTime").alias("updated")]
    if with_md5:
        cols.append(F.md5(F.col("content")).alias("md5"))
    return df.select(*cols)


def list_tree(spark: SparkSession, root: str, folder: str | None = None, glob: str | None = None) -> DataFrame:
    """Files under root/folder keyed by the path relative to that folder."""
    base = root.rstrip("/") + ("/" + folder.strip("/") if folder else "")
    lst = list_objects(spark, base, glob)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    resolved = re.sub(r"^file:(//(?=/))?", "", fs.resolvePath(path).toString()).rstrip("/")
    return lst.withColumn("rel_path", F.substring("path", len(resolved) + 2, 2 ** 31 - 1))


def scan_workbooks(spark: SparkSession, roots: Sequence[str], folder_filter: str | None = None) -> DataFrame:
    """*.xlsx under each root (recursive); folder label = parent directory name, or the
    root's own name for files directly in the root; optional case-insensitive path filter."""
    frames = []
    for root in roots:
        root_name = root.rstrip("/").split("/")[-1]
        df = list_objects(spark, root, "*.xlsx")
        parent = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
        folder = F.when(parent == root_name, F.lit(root_name)).otherwise(parent)
        frames.append(df.select("path", folder.alias("source_folder"), path_stem("path").alias("stem"),
                                "size", "updated", F.lit(root_name).alias("kind")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if folder_filter:
        out = out.where(F.lower("path").contains(folder_filter.lower()))
    return out


def scan_code(spark: SparkSession, root: str, exts: Sequence[str] = (".sql", ".py"), any_case: bool = True) -> DataFrame:
    """Whole files with path, name and content for the given suffixes, in any case or, as the scan of the
    reconcile job (P8), exactly as written."""
    df = (spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
          .select(_input_file().alias("path"), F.col("value").alias("content")))
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    fits = F.lower(suffix).isin(*[e.lower() for e in exts]) if any_case else reduce(
        lambda a, b: a | b, [F.col("path").endswith(e) for e in exts])
    return df.where(fits).select(
        "path", path_name(F.col("path")).alias("name"), "content")


def read_delimited(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with a header row (schema inference optional)."""
    return spark.read.option("header", "true").option("inferSchema", str(infer).lower()).csv(path)


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON store with a fixed schema.  A missing store is empty; a store with a line
    that does not parse is corrupt as a whole and is empty too (never a partial table)."""
    try:
        raw = spark.read.schema(StructType([*schema.fields, StructField("_corrupt", StringType())])).option(
            "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    # every column is asked for, so every line is parsed in full
    broken = raw.where(F.col("_corrupt").isNotNull()).select(*raw.columns).limit(1).collect()
    return spark.createDataFrame([], schema) if broken else raw.select(*schema.names)


MAPPING_VALUE = StructType([StructField("bq_table", StringType()), StructField("dag_names", ArrayType(StringType()))])


def read_mapping_config(spark: SparkSession, path: str) -> DataFrame:
    """{stem: {bq_table, dag_names}} → one row per stem (dag_names kept as array)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", MapType(StringType(), MAPPING_VALUE))
    return raw.select(F.explode(m).alias("stem", "v")).select("stem", "v.bq_table", "v.dag_names")


def mapping_dags(config: DataFrame) -> DataFrame:
    """Stem → one row per DAG (stems without DAGs keep one row with a null DAG)."""
    return config.select("stem", "bq_table", F.explode_outer("dag_names").alias("dag_id"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files → (path, line_no, line), line numbers 1-based per file.

    Files are read line by line with the splittable text source, so a huge log is spread
    over many tasks (never one value).  Within a split, rows keep file order; a line's
    number is the count of lines in the file's earlier splits (a small per-split table)
    plus its position within its own split.  Lines end at \\n, \\r\\n or \\r, and a final
    newline does not add an empty line (as ``str.splitlines``)."""
    raw = (spark.read.option("recursiveFileLookup", "true").text(path)
           .select(_input_file().alias("path"),
                   F.input_file_block_start().alias("_blk"),
                   F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")))
    blocks = raw.groupBy("path", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (raw.join(blocks, ["path", "_blk"])
            .select("path", (F.col("_off") + F.col("_id") - F.col("_first") + 1).cast("long").alias("line_no"),
                    "line"))


# fixed values: the payload layouts of landed scheduler dumps
RUN_SCHEMA = StructType([
    StructField("dag_id", StringType()), StructField("dag_run_id", StringType()),
    StructField("logical_date", StringType()), StructField("execution_date", StringType()),
    StructField("start_date", StringType()), StructField("end_date", StringType()),
    StructField("state", StringType()), StructField("run_type", StringType())])
TASK_INSTANCE_SCHEMA = StructType([
    StructField("dag_id", StringType()), StructField("dag_run_id", StringType()),
    StructField("task_id", StringType()), StructField("state", StringType()),
    StructField("start_date", StringType()), StructField("end_date", StringType()),
    StructField("duration", DoubleType()), StructField("try_number", LongType()),
    StructField("operator", StringType()), StructField("rendered_fields", StringType())])
TASK_SCHEMA = StructType([
    StructField("task_id", StringType()),
    StructField("class_ref", StructType([StructField("class_name", StringType())])),
    StructField("downstream_task_ids", ArrayType(StringType())),
    StructField("trigger_dag_id", StringType()), StructField("sql", StringType()),
    StructField("query", StringType()), StructField("bql", StringType()),
    # nested objects come as their JSON text
    StructField("configuration", StringType()), StructField("conf", StringType()),
    StructField("params", StringType())])
DAG_SCHEMA = StructType([
    StructField("dag_id", StringType()), StructField("schedule_interval", StringType()),
    StructField("is_paused", BooleanType()),
    StructField("tags", ArrayType(StructType([StructField("name", StringType())]))),
    StructField("file_loc", StringType()), StructField("fileloc", StringType())])


def _payload(spark: SparkSession, path: str, key: str, item: StructType) -> DataFrame:
    schema = StructType([StructField(key, ArrayType(item))])
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    return df.select(F.explode(key).alias("r")).select("r.*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """dag_runs payloads → runs; logical_date falls back to execution_date; ISO text
    (a trailing Z allowed) parsed to timestamps."""
    r = _payload(spark, path, "dag_runs", RUN_SCHEMA)
    ts = lambda c: F.try_to_timestamp(F.regexp_replace(F.col(c), "Z$", ""))
    return r.select("dag_id", F.col("dag_run_id").alias("run_id"),
                    ts("logical_date").alias("_l"), ts("execution_date").alias("_e"),
                    ts("start_date").alias("start_date"), ts("end_date").alias("end_date"),
                    "state", "run_type").select(
        "dag_id", "run_id", F.col("run_id").alias("run_key"), F.coalesce("_l", "_e").alias("logical_date"),
        "start_date", "end_date", "state", "run_type")


def read_task_instances(spark: SparkSession, path: str) -> DataFrame:
    """task_instances payloads in the shape the run operators take (run_id,
    duration_s, parsed timestamps, and ``event_id`` = payload order for "first n")."""
    t = _payload(spark, path, "task_instances", TASK_INSTANCE_SCHEMA)
    ts = lambda c: F.try_to_timestamp(F.regexp_replace(F.col(c), "Z$", ""))
    return t.select(F.monotonically_increasing_id().alias("event_id"), "dag_id",
                    F.col("dag_run_id").alias("run_id"), "task_id", "state",
                    F.col("duration").alias("duration_s"), ts("start_date").alias("start_date"),
                    ts("end_date").alias("end_date"), "try_number", "operator", "rendered_fields")


def read_tasks(spark: SparkSession, path: str, dag_id: str | None = None) -> DataFrame:
    """Per-DAG task definitions in the shape the graph operators take.  The payload
    does not name its DAG: ``dag_id`` is given, or taken from each file's name (stem)."""
    schema = StructType([StructField("tasks", ArrayType(TASK_SCHEMA))])
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    dag = F.lit(dag_id) if dag_id is not None else path_stem(_input_file())
    t = df.select(dag.alias("dag_id"), F.explode("tasks").alias("r")).select("dag_id", "r.*")
    own = {c: F.col(c) for c in ("sql", "query", "bql")}
    own["configuration"] = F.try_parse_json("configuration")
    return t.select("dag_id", "task_id", F.col("class_ref.class_name").alias("operator"), "downstream_task_ids",
                    "trigger_dag_id", F.coalesce("sql", "query", "bql").alias("sql"), "conf", "params",
                    F.to_json(F.struct(*[c.alias(k) for k, c in own.items()])).alias("definition"))


def read_dags(spark: SparkSession, path: str) -> DataFrame:
    d = _payload(spark, path, "dags", DAG_SCHEMA)
    return d.select("dag_id", "schedule_interval", "is_paused", "tags",
                    F.coalesce(F.nullif("file_loc", F.lit("")), "fileloc").alias("file_loc"))


def changed_files(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """T1 (batch): files that are new or whose modification time differs from the
    registry's (anti-join on path and time)."""
    seen = registry.select(F.col("file_path").alias("path"), F.col("file_mtime").alias("updated"))
    return listing.join(seen, ["path", "updated"], "left_anti")
