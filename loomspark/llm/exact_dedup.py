"""Exact deduplication with disk-backed streaming state.

Each text is reduced to the SHA-256 of its bytes without white space.  A Structured Streaming
aggregation keyed by that digest keeps, in RocksDB and without expiry, the number of rows and
the best row so far: its length, stable identifier and content locator (file and row).  Map-side
partial aggregation collapses hot groups before the shuffle.  The same state folder can be used
again for later deliveries; new rows then meet everything seen before.

Digests that were hit more than once are checked on full bytes: their texts are grouped by the
normalised text itself.  For texts of earlier deliveries their locators are followed to the files that
hold them.  A digest that covers different texts is split into its true groups.
"""
from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, small, work_dir, written

#: ASCII white space that equality ignores.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of digest rows per micro-batch.
BATCH_BYTES = 1 << 30

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # many small stores: no disk space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _advance(spark: SparkSession, schema, rows: str, state: str, batch_bytes: int) -> DataFrame:
    """Feed the digest rows not seen yet into the state; return the state's content."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = (spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(rows)
                  .groupBy("digest")
                  .agg(F.count(F.lit(1)).alias("rows"), F.min("best").alias("best")))
        query = (stream.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", state).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(state)
    count, best = kept.schema["value"].dataType.names
    return kept.select(F.col("key.digest").alias("digest"), F.col("value")[count].alias("rows"),
                       F.col("value")[best].alias("best"))


def _earlier_texts(spark: SparkSession, schema, root: str, delivery: str, known: DataFrame, text_col: str) -> DataFrame:
    """``digest, norm, best`` of the rows of earlier deliveries that have one of the known digests, read where their
    locators point."""
    past = (spark.read.schema(schema).parquet(f"{root}/digests/*")
            .where(~F.col("_metadata.file_path").contains(f"/digests/{delivery}/")).join(known, "digest", "left_semi"))
    past = written(past, f"{root}/earlier/{delivery}")
    files = [unquote(r["file"]) for r in past.select("best.file").distinct().collect()]  # names of files only
    if not files:
        return past.select("digest", F.lit("").alias("norm"), "best").limit(0)
    texts = spark.read.parquet(*files).select(normalised(F.col(text_col)).alias("norm"), F.col("_metadata.file_path").alias("f"),
                                              F.col("_metadata.row_index").alias("r"))
    return past.join(texts, (F.col("best.file") == F.col("f")) & (F.col("best.row") == F.col("r"))).select("digest", "norm", "best")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None,
                digest: Callable[[Column], Column] = sha256_hex, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, __file, __row``.

    Equal texts share everything but blanks.  Of a group the row with the most code points in its
    original text stays, then the smallest id (null ids last), then the first row by place: repeated
    rows leave exactly one.  Null text counts as empty; all empty texts are one group.  An empty
    table gives no rows.  ``digest`` may be any function of the normalised text: full bytes decide.
    With ``state_dir`` the state of earlier calls counts too: the row that stays may then lie in an earlier
    delivery, whose files must still be there (with the same text column), since hits are checked on their bytes.
    Texts of any length are read whole."""
    spark = docs.sparkSession
    root = state_dir or work_dir(spark, "exact-dedup")
    src = located(docs, [id_col, text_col], work_dir(spark, "exact-dedup-input"))
    norm = normalised(F.col(text_col))
    n = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    best = F.struct((-n).cast("long").alias("neg_len"), F.col(id_col).isNull().alias("no_id"),
                    F.col(id_col).alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    rows = src.select(digest(norm).alias("digest"), best.alias("best"))
    delivery = work_dir(spark, "digests").rsplit("/", 1)[-1]
    thin = written(rows, f"{root}/digests/{delivery}")
    state = written(_advance(spark, rows.schema, f"{root}/digests/*", f"{root}/state", batch_bytes),
                    f"{root}/groups/{delivery}")

    hits = state.where("rows > 1").select("digest")
    if state_dir:  # of the digests of this delivery only
        hits = written(hits.join(thin.select("digest"), "digest", "left_semi"), f"{root}/hits/{delivery}")
    known = small(hits, hits.count(), 100)
    texts = src.select(digest(norm).alias("digest"), norm.alias("norm"), best.alias("best")).join(
        known, "digest", "left_semi")
    if state_dir:
        earlier = _earlier_texts(spark, rows.schema, root, delivery, known, text_col)
        texts = texts.withColumn("now", F.lit(True)).unionByName(earlier.withColumn("now", F.lit(False)))
    classes = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"), F.min("best").alias("best"))
    clash = written(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
                    .select("digest"), f"{root}/clashes/{delivery}")
    clashes = clash.count()

    full = thin.join(state.withColumnsRenamed({"best": "top"}), "digest")
    if clashes:
        split = texts.join(small(clash, clashes, 100), "digest", "left_semi")
        if state_dir:  # earlier texts have told the groups apart; the rows are this delivery's
            split = split.where("now")
        own = (classes.withColumnsRenamed({"best": "top"}).join(small(clash, clashes, 100), "digest", "left_semi"))
        split = split.join(own, ["digest", "norm"]).select("best", "top", "rows", sha256_hex(F.col("norm")).alias("sha"))
        full = full.join(small(clash, clashes, 100), "digest", "left_anti")
    else:
        split = None
    if digest is sha256_hex:
        full = full.select("best", "top", "rows", F.col("digest").alias("sha"))
    else:
        place = src.select(sha256_hex(norm).alias("sha"), F.col("__file"), F.col("__row"))
        full = full.join(place, (F.col("best.file") == F.col("__file")) & (F.col("best.row") == F.col("__row")))
        full = full.select("best", "top", "rows", "sha")
    out = full if split is None else full.unionByName(split)
    return out.select(
        F.col("best.id").alias(id_col), F.col("top.id").alias("keep_id"), F.col("rows").alias("group_size"),
        ((F.col("best.file") == F.col("top.file")) & (F.col("best.row") == F.col("top.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"), F.col("best.file").alias("__file"), F.col("best.row").alias("__row"))
