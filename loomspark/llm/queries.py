"""The training-data queries: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import hard_negatives, imatch, language_id, neighbours, packing, pii, quality, secrets, spelling, tokens, url_lists
from .exact_dedup import exact_dedup
from .near_dedup import near_dedup

LLM_QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        LLM_QUERIES[name] = fn
        return fn
    return deco


@register("op2_exact_dedup")
def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf, "documents")).drop("__file", "__row")


@register("op5_secrets")
def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.summary(secrets.find_secrets(read_table(spark, sf, "documents")))


@register("op10_quality")
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf, "labels")))


@register("op3_language_id")
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return language_id.identify(docs, language_id.fit(docs))


@register("op9_packing")
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read_table(spark, sf, "documents"))


@register("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup(read_table(spark, sf, "documents")).drop("__file", "__row")


@register("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.digest(read_table(spark, sf, "documents"), tokens.load_vocabulary())


@register("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf, "embeddings"))


def fetched(pages: DataFrame) -> DataFrame:
    """Captures with a fetch time: a day of 2024 by the page's number."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(
        F.col("page_id") * 7919, F.lit(366)).cast("int")).cast("timestamp").alias("fetched_at"))


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts, parent domains and first path segments of the pages: a hash of each
    name says whether it is listed and when it is added, removed and added again."""
    host = url_lists.url_host(F.col("url"))
    seg = F.regexp_extract(url_lists.url_path(F.col("url")), r"^/([^/]+)", 1)
    names = pages.select(F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(3).alias("m")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_replace(host, r"^[^.]+\.", "").alias("value"), F.lit(2).alias("m")),
        F.struct(F.lit("prefix").alias("kind"), F.when(seg != "", F.concat_ws("/", host, F.lower(seg))).alias("value"),
                 F.lit(4).alias("m")))).alias("e")).select("e.*").where("value is not null").distinct()
    h = F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 6), 16, 10).cast("int")
    day = (F.floor(F.col("h") / 16) % 300).cast("int")
    listed = names.withColumn("h", h).where(F.col("h") % F.col("m") == 0)
    return listed.select("kind", "value", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), day.alias("day")),
        F.struct(F.lit("remove").alias("action"), (day + 45).alias("day")),
        F.struct(F.lit("add").alias("action"), (day + 90).alias("day")))).alias("x")).select(
        "kind", "value", "x.action", F.date_add(F.lit("2024-01-01").cast("date"), F.col("x.day")).cast("timestamp").alias("at"))


@register("op7_url_lists")
def op7_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages")
    out = url_lists.evaluate(fetched(pages), list_events(pages))
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd"))


@register("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.summary(pii.find_personal_data(read_table(spark, sf, "documents")))


@register("op11_imatch")
def op11_imatch(spark: SparkSession, sf: str) -> DataFrame:
    return imatch.compare_edits(read_table(spark, sf, "documents"))


@register("op13_hard_negatives")
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


@register("op12_spelling")
def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    found = spelling.runs(read_table(spark, sf, "documents"), "doc_id", "text", 5)
    words = found.select(spelling.with_typos(F.col("run"), F.col("id")).alias("word"))
    return spelling.variants(spelling.counted(words, 5, 3))
