"""The corpus pipeline: language, exact copies, near copies, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on everything its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import language_id, packing, secrets
from loomspark.llm.common import small, work_dir, written
from loomspark.llm.exact_dedup import exact_dedup
from loomspark.llm.near_dedup import near_dedup


def _on_files(docs: DataFrame) -> DataFrame:
    """``docs`` as rows of files, which have a place; other rows are written first."""
    try:
        docs.select("_metadata.row_index").schema
        return docs
    except AnalysisException:
        return written(docs, work_dir(docs.sparkSession, "stage-input"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose place is not among the dropped ones."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    placed = docs.select("*", F.col("_metadata.file_path"), F.col("_metadata.row_index")).toDF(
        *names, "__file", "__row")
    gone = written(dropped.select("__file", "__row"), work_dir(docs.sparkSession, "dropped"))
    return placed.join(small(gone, gone.count(), 250), ["__file", "__row"], "left_anti").select(*names).toDF(
        *docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: rejected texts go (null, without a letter, unlike all centroids)."""
    model = language_id.fit(docs)
    return language_id.accepted(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    docs = _on_files(docs)
    return _without(docs, exact_dedup(docs).where("not kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    docs = _on_files(docs)
    return _without(docs, near_dedup(docs).where("not kept"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text where that changed."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    src = docs.toDF(*names)
    if "n_chars" in docs.columns:
        n, t = names[docs.columns.index("n_chars")], names[docs.columns.index("text")]
        out = secrets.masked(src.withColumn("was", F.char_length(t)), text_col=t)
        changed = ~F.col("was").eqNullSafe(F.char_length(t))
        out = out.withColumn(n, F.when(changed, F.char_length(t).cast(src.schema[n].dataType)).otherwise(F.col(n)))
        return out.select(*names).toDF(*docs.columns)
    return secrets.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training bins."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("secrets", mask_secrets), ("packing", pack)]

#: Models and alignments have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    root = work_dir(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{root}/{name}")
    return docs
