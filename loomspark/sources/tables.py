"""The driver's parquet tables, one file per table under ``sf_dir``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLE_NAMES) -> None:
    """Publish every table as a temp view of the same name (for ``run_sql``)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
