"""Helpers shared by the training-data operators: column picking, shared work tables, checked broadcasts."""
from __future__ import annotations

import uuid
from functools import reduce
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

#: Largest estimated size of a side that is sent to every executor; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows in an Arrow batch for Python.
BATCH_ROWS = 500


def pick(df: DataFrame, *names: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Exactly the named columns, by exact spelling and position, so that other columns of any
    name (also ``TEXT`` beside ``text``) never get in the way.  A missing column is a ValueError."""
    cols = df.columns
    missing = [n for n in names if n not in cols]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {cols}")
    at = [cols.index(n) for n in names]
    tmp = [f"__c{i}" for i in range(len(cols))]
    out = df.select("*", *extra)
    more = out.columns[len(cols):]
    out = out.toDF(*tmp, *more)
    return out.select(*[F.col(tmp[i]).alias(n) for i, n in zip(at, names)], *more)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts the lineage, survives lost executors."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(docs: DataFrame, names: Sequence[str], path: str) -> DataFrame:
    """The named columns plus ``__file`` and ``__row``, the place of each row in its Parquet files.
    Rows that are not read straight from files are first written below ``path``."""
    place = (F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    try:
        out = pick(docs, *names, extra=place)
        out.schema  # resolves the columns
        return out
    except AnalysisException:
        return pick(written(pick(docs, *names), path), *names, extra=place)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its known row count proves it small, else unchanged (shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def in_order(rows: DataFrame, path: str, *order: Column) -> DataFrame:
    """``rows`` with ``pos``, their places from 0 in a total order, written below ``path``: range partitions are
    sorted, and the sizes of the partitions before give each its offset."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("mid", F.monotonically_increasing_id()), f"{path}/dealt")
    part = F.call_function("shiftright", F.col("mid"), F.lit(33))
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = dealt.withColumn("part", part).join(small(sizes, parts, 40), "part").withColumn(
        "pos", F.col("offset") + F.col("mid").bitwiseAND((1 << 33) - 1))
    return written(out.drop("mid", "part", "offset"), f"{path}/ordered")


def bounded_sample(rows: DataFrame, keys: Sequence[str], most: int, h: str, *ties: str) -> DataFrame:
    """At most ``most`` rows of each combination of ``keys``, the first in the order of the hash column ``h`` (a long)
    and ``ties``.  A threshold on the hash, from the counts of the combinations, leaves about four times as many
    (all, where there are no more) before they are ranked, so that no task gets a combination whole."""
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    same = [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    total = total.toDF(*[f"__k{i}" for i in range(len(keys))], "__total")
    near = rows.join(total, reduce(lambda a, b: a & b, same)).where(
        F.pmod(F.col(h), F.lit(1 << 40)) * F.col("__total") < F.lit(4.0 * most * (1 << 40)))
    first = Window.partitionBy(*keys).orderBy(h, *ties)
    return near.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most).select(*rows.columns)


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id's text, modulo 3, is 1 (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long: at most ``BATCH_ROWS`` rows go to a Python task at a time in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(df: DataFrame, make: Callable[[], Callable], fields: str, text: str = "text") -> DataFrame:
    """Replace the column ``text`` by ``fields`` (a DDL string), computed in Arrow batches.  ``make`` runs once
    per task and returns a function from a list of texts to one sequence per field.  Other columns pass
    through unchanged as Arrow data (no pandas conversion, so null ids keep their type)."""
    bounded_batches(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != text]
    new = StructType.fromDDL(fields)
    types = [to_arrow_type(f.dataType) for f in new.fields]
    names = [f.name for f in rest] + new.names
    keep = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            cols = work(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(n)) for n in keep]
                + [pa.array(c, t) for c, t in zip(cols, types)], names=names)
    return df.mapInArrow(run, StructType([*rest, *new.fields]))
