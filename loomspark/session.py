"""Session construction and lineage-cut helpers.

On a cluster the session is created by the platform; ``build_session`` only fills
in settings that are not already present, so cluster-provided values win.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults that matter for correctness (UTC) and for scale (AQE, skew handling).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # top-n per group keeps only n rows per key before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def build_session(master: str | None = None, app: str = "loomspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Where that is unset (as in tests), a folder
    in the session's warehouse, which driver and executors share too; it goes when the session ends."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        d = f"{base}/_checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", d)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir`` (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back.  For loops: a checkpoint keeps the size that
    the plan was estimated at, and sizes of joins multiply, so after some rounds of joins of a table with
    itself planning works on numbers of a million digits; files have their real size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def recommended_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Partition sizing for a job reading ``input_bytes`` on ``total_cores`` executor cores:
    file splits and shuffle partitions of about ``target_partition_bytes`` (so a task's data
    fits in executor memory and spills stay small), at least three tasks per core, and AQE
    left free to merge small partitions or split skewed ones at run time."""
    parts = max(total_cores * 3, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }
