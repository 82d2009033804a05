"""Approximate nearest neighbours by inner product with shifted Hilbert curves.

Inner products become distances by one extra coordinate (the room that a vector's norm leaves to
the largest norm; 0 for queries, which are scaled to it).  Each of ``CURVES`` orderings projects
the vectors to a few random directions, shifts them at random and sorts them along a Hilbert
curve: Spark range-partitions all orderings by (curve, key), and every row gets its place.  A query
meets the rows in a window around its own place on every curve, in blocks of rows: it is sent to the few
blocks that its window touches, and no block meets another.  Only keys travel to be sorted; the vectors
join their places once.  The best of all curves are merged and reranked by exact inner products.

Equal vectors are one entry that carries its smallest ids (no more can be in a result), so copies
neither crowd a window nor a task.

Windows set cost against recall.  ``window_rows`` fixes them: then the work of a query does not grow with
the table.  Vectors without structure have no near neighbours that any ordering could bring
together; the given ones have 64 almost equal directions, so the default is a share of the table, a
small one on many curves.  Their work is just below that of brute force.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, pick, small, work_dir, written

CURVES = 32
DIRECTIONS = 6
BITS = 10
WINDOW_SHARE = 0.02
#: Rows of a block at least (else a quarter of a window), and queries that meet a block in one task at most (about).
BLOCK_ROWS = 512
QUERY_ROWS = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (n, d) with coordinates below 2**bits; the cells are
    turned level by level, from the coarsest bit, into the curve's own frame, then Gray-decoded."""
    x = cells.T.astype(np.int64)
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level) & 1
    return key


def _frames(dim: int, curves: int) -> tuple[np.ndarray, np.ndarray]:
    """Random orthogonal directions of each curve (curves, dim, DIRECTIONS) and its shifts."""
    rnd = np.random.default_rng(11)
    k = min(DIRECTIONS, dim)
    ways = np.array([np.linalg.qr(rnd.normal(size=(dim, dim)))[0][:, :k] for _ in range(curves)])
    return ways, rnd.uniform(0, 0.5, (curves, k))


def _projected(batch: pa.RecordBatch, ways: np.ndarray, top: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (n, dim) and their projections (curves, n, directions), with the extra coordinate."""
    x = batch.column(batch.schema.get_field_index("vec")).flatten().to_numpy(zero_copy_only=False) \
        .astype(np.float64).reshape(-1, dim)
    query = batch.column(batch.schema.get_field_index("query")).to_numpy(zero_copy_only=False).astype(bool)
    norm = np.sqrt((x * x).sum(axis=1))
    y = np.where(query[:, None], x * (top / np.maximum(norm, 1e-300))[:, None], x)
    extra = np.where(query, 0.0, np.sqrt(np.maximum(top * top - norm * norm, 0.0)))
    return x, np.einsum("nd,cdk->cnk", np.concatenate((y, extra[:, None]), axis=1), ways)


def search(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           every: int = 20, window_share: float = WINDOW_SHARE, window_rows: int | None = None,
           curves: int = CURVES) -> DataFrame:
    """For each row whose id is divisible by ``every``: its ``k`` nearest among all other rows, as
    ``query_id, rank, vec_id, score`` (rank from 1 by descending inner product, ties to the smaller id).

    Rows with a null id, and vectors that are null, zero, hold null or non-finite components, or differ in
    length from most others, take no part.  Rows repeated with id and vector count once.  Fewer rows than
    ``k`` + 1: all of them.  Nothing comes from an empty table.  Windows hold ``window_rows`` rows of a curve,
    by default ``window_share`` of them; whole blocks are searched."""
    spark = vectors.sparkSession
    root = work_dir(spark, "neighbours")
    v = F.col("vec")
    rows = (pick(vectors, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"),
                                                  F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & F.size(v).cast("int").__gt__(0)
                   & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
                   & F.exists(v, lambda c: c != 0)))
    narrow = vectors.schema[vectors.columns.index(vec_col)].dataType.simpleString() == "array<float>"
    sizes = rows.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["dim"]
    rows = rows.where(F.size(v) == dim)

    first = Window.partitionBy("vec").orderBy("id")
    entries = (rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
               .groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
               .select(F.element_at("ids", 1).alias("cid"), "vec", "ids"))
    # an id given to several vectors may head two entries; (cid, place) tells them apart
    entries = written(entries.withColumn("eid", F.monotonically_increasing_id()), f"{root}/entries")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "vec").distinct()
    asked = written(asked.join(entries.select("vec", "eid"), "vec").select("id", "eid"), f"{root}/asked")
    n_asked = asked.select("eid").distinct().count()
    on_curve = entries.count() + n_asked
    top = entries.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c)))).first()[0]

    both = entries.select("eid", "vec", F.lit(False).alias("query")).unionByName(
        entries.join(asked.select("eid").distinct(), "eid", "left_semi").select("eid", "vec", F.lit(True).alias("query")))
    ways, shifts = _frames(dim + 1, curves)
    project, cells_of, bits = _projected, hilbert_keys, BITS

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = project(b, ways, top, dim)[1]
            at = np.arange(p.shape[0] * p.shape[2], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(p.sum(axis=1).ravel()), pa.array((p * p).sum(axis=1).ravel()),
                 pa.array(np.full(len(at), float(p.shape[1])))], names=["at", "s", "s2", "n"])
    sums = both.where("not query").mapInArrow(moments, "at int, s double, s2 double, n double").groupBy("at").agg(
        F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum("n").alias("n")).orderBy("at").collect()
    mean = np.array([r["s"] / r["n"] for r in sums]).reshape(curves, 1, -1)
    wide = np.array([max(r["s2"] / r["n"] - (r["s"] / r["n"]) ** 2, 1e-18) ** 0.5 for r in sums]).reshape(curves, 1, -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = (project(b, ways, top, dim)[1] - mean) / wide
            u = np.clip((p + 3 + shifts[:, None, :]) / 6.5, 0, 1 - 1e-9)
            for c in range(len(u)):
                key = cells_of((u[c] * (1 << bits)).astype(np.int64), bits)
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("eid")), b.column(b.schema.get_field_index("query")),
                     pa.array(np.full(b.num_rows, c, np.int32)), pa.array(key)], names=["eid", "query", "curve", "key"])
    placed = both.mapInArrow(place, "eid long, query boolean, curve int, key long")
    ordered = in_order(placed, f"{root}/curves", *map(F.col, ("curve", "key", "query", "eid")))

    # places on the own curve, and the blocks that a query's window touches
    width = window_rows or max(1, round(window_share * on_curve))
    block_rows = max(BLOCK_ROWS, width // 4)
    at = F.col("pos") - F.col("curve").cast("long") * on_curve
    block = lambda c: F.floor(c / block_rows).cast("long")
    spots = ordered.where("query").select("eid", "curve", F.explode(F.sequence(
        block(F.greatest(at - width // 2, F.lit(0))), block(F.least(at + width // 2, F.lit(on_curve - 1))))).alias("block"))
    spots = written(spots, f"{root}/spots")
    parts = spots.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("parts"))
    parts = written(parts, f"{root}/parts")
    spread = small(parts, parts.count(), 40)
    kind = "array<float>" if narrow else "array<double>"
    vectors_ = entries.select("eid", "cid", F.col("vec").cast(kind).alias("vec"))
    queries = (spots.join(spread, ["curve", "block"]).withColumn("part", F.pmod(F.xxhash64("eid"), F.col("parts")))
               .join(vectors_.drop("cid"), "eid").select("eid", "vec", "curve", "block", "part"))
    again = spark.read.schema(ordered.schema).parquet(f"{root}/curves/ordered")  # column ids of its own for the cogroup
    base = (again.where("not query").select("eid", "curve", block(at).alias("block"))
            .join(spark.read.schema(parts.schema).parquet(f"{root}/parts"), ["curve", "block"])
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .join(vectors_.select(*[F.col(c).alias(c) for c in vectors_.columns]), "eid")
            .select("eid", "cid", "vec", "curve", "block", "part"))
    best = _best_of_block(k + 1)
    found = (queries.groupBy("curve", "block", "part").cogroup(base.groupBy("curve", "block", "part"))
             .applyInPandas(best, "qid long, eid long, score double"))
    merged = found.groupBy("qid", "eid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    merged = (merged.withColumn("r", F.dense_rank().over(Window.partitionBy("qid").orderBy(F.desc("score"))))
              .where(F.col("r") <= k + 1).join(entries.select("eid", "ids"), "eid")
              .select("qid", "score", F.explode("ids").alias("id"))
              .withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.select(F.col("id").alias("query_id"), F.col("eid").alias("qid")).join(merged, "qid")
            .withColumnRenamed("id", "vec_id").where("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _best_of_block(k: int):
    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(base):
            return pd.DataFrame({"qid": [], "eid": [], "score": []}).astype({"qid": "int64", "eid": "int64"})
        q, b = (np.stack(x["vec"].to_numpy()).astype(np.float64) for x in (queries, base))
        qid, eid, cid = queries["eid"].to_numpy(), base["eid"].to_numpy(), base["cid"].to_numpy()
        # a few more than k by the fast product, then the plain sum of products and the smallest id decide
        m = min(len(b), k + 4)
        error = 4 * b.shape[1] * np.finfo(np.float64).eps * np.sqrt((b * b).sum(axis=1).max())
        out = []
        for i in range(0, len(q), 512):
            fast = q[i:i + 512] @ b.T
            at = np.argpartition(-fast, m - 1, axis=1)[:, :m] if m < len(b) else np.tile(np.arange(m), (len(fast), 1))
            exact = (b[at] * q[i:i + 512][:, None, :]).sum(axis=2)
            rank = np.lexsort((eid[at], cid[at], -exact), axis=1)[:, :k]
            at, exact = np.take_along_axis(at, rank, 1), np.take_along_axis(exact, rank, 1)
            if m < len(b):  # rows cut at the border may tie with the last: then every row down to it is measured
                least = exact[:, -1] - error * np.sqrt((q[i:i + 512] ** 2).sum(axis=1))
                near = fast >= least[:, None]
                for j in np.flatnonzero(near.sum(axis=1) > m):
                    all_ = np.flatnonzero(near[j])
                    sums = (b[all_] * q[i + j]).sum(axis=1)
                    first = np.lexsort((eid[all_], cid[all_], -sums))[:k]
                    at[j], exact[j] = all_[first], sums[first]
            out.append((np.repeat(qid[i:i + 512], at.shape[1]), eid[at].ravel(), exact.ravel()))
        qs, es, ss = map(np.concatenate, zip(*out))
        return pd.DataFrame({"qid": qs, "eid": es, "score": ss})
    return run


def recall(found: DataFrame, vectors: DataFrame, k: int = 20, sample: int = 200, every: int = 20) -> float:
    """Share of the true ``k`` nearest that ``found`` (a result of ``search``) has, over ``sample`` queries
    (the first by a hash of their ids), against brute force over all rows in blocks."""
    some = [r["query_id"] for r in found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(sample)
            .collect()]
    if not some:
        return 1.0
    src = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").alias("id"),
                                                      F.col("embedding").cast("array<double>").alias("vec"))
    src = src.where("id is not null and vec is not null and not exists(vec, c -> c is null or isnan(c))")
    asked = [(r["id"], list(r["vec"])) for r in src.where(F.col("id").isin(some)).collect()]
    qid, q = np.array([a for a, _ in asked]), np.array([b for _, b in asked])
    dim = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = t.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            ids = t.column(0).to_numpy(zero_copy_only=False)
            s = q @ x.T
            s[qid[:, None] == ids[None, :]] = -np.inf
            m = min(k, len(ids))
            at = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qid, m)), pa.array(ids[at].ravel()),
                 pa.array(np.take_along_axis(s, at, 1).ravel())], names=["query_id", "vec_id", "s"])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 12)), "vec_id")
    true = (src.where(F.size("vec") == dim).mapInArrow(run, "query_id long, vec_id long, s double")
            .where("s > double('-infinity')")
            .withColumn("r", F.row_number().over(order)).where(F.col("r") <= k))
    hits = true.join(found, ["query_id", "vec_id"], "left").agg(
        F.count("rank").alias("hit"), F.count(F.lit(1)).alias("all")).first()
    return hits["hit"] / hits["all"]
