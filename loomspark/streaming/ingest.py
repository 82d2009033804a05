"""Continuous workbook ingest and audit append.

A ``binaryFile`` stream over the workbook folders picks up files under new paths (the file
source remembers the paths it has seen in its checkpoint; a file rewritten in place is for
the batch form, ``workbook.ingest`` with the registry).  Each micro-batch is decoded
once, in parallel; the registry gets a new version keyed by file path (newest mtime wins)
and every batch has its own folder of cells and of audit rows.  A batch that is replayed
overwrites its own folders and starts from the registry before it, so state is the same.
The registry folder belongs to the stream: its versions are batch numbers.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import audit_record, upsert
from ..sources import sinks
from ..sources.workbook import read_workbook_cells, registry_entries

# the binaryFile source's fixed columns (a stream must declare them)
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start_workbook_stream(spark: SparkSession, root: str, kind: str, registry_base: str, audit_path: str,
                          checkpoint: str, cells_path: str):
    stream = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(root))
    root_name = root.rstrip("/").split("/")[-1]
    parent = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    files = stream.select(F.regexp_replace("path", "^file:", "").alias("path"), "content",
                          F.col("modificationTime").alias("file_mtime"), F.lit(kind).alias("kind"),
                          F.when(parent == root_name, F.lit(root_name)).otherwise(parent).alias("source_folder"))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        own = f"batch={batch_id}"
        cells_out = f"{cells_path.rstrip('/')}/{own}"
        read_workbook_cells(batch).write.mode("overwrite").parquet(cells_out)
        cells = spark.read.parquet(cells_out)
        entries = registry_entries(batch, cells).withColumn("batch", F.lit(batch_id).cast("long"))
        current = sinks.latest_version(spark, registry_base, before=batch_id)
        nxt = entries if current is None else upsert(current, entries, ["file_path"], "file_mtime")
        sinks.write_version(nxt, registry_base, version=batch_id, mode="overwrite")
        loaded = sinks.latest_version(spark, registry_base, before=batch_id + 1).where(F.col("batch") == batch_id)
        audit_record(loaded, "workbook", root, f"ingest batch {batch_id}").write.mode("overwrite").json(
            f"{audit_path.rstrip('/')}/{own}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()


def current_cells(spark: SparkSession, registry_base: str, cells_path: str) -> DataFrame:
    """The cells of the newest version of every workbook (older batches of a rewritten file drop out)."""
    entries = sinks.latest_version(spark, registry_base).select(F.col("file_path").alias("path"), "batch")
    cells = spark.read.option("basePath", cells_path).parquet(cells_path).withColumn("batch", F.col("batch").cast("long"))
    return cells.join(entries, ["path", "batch"], "left_semi").drop("batch")
