"""Best-fit packing with conflicts.

Documents fill bins of a fixed capacity.  A document longer than a bin is cut into full pieces and
a rest.  Bins stand in the order of their room; each carries a bitmap of the sources and a bitmap
of the duplicate clusters in it.  A piece, longest first, goes to the tightest bin that holds it
and shares neither source nor cluster with it: the search starts at the successor of its length
and goes on until a compatible bin is found, else a new bin opens.

Pieces are dealt at random to shards of about ``SHARD_ROWS`` pieces, each packed by one task, so
neither a hot source nor a group of copies gathers in one place; bins never cross shards.  Full
pieces need no search.
"""
from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, work_dir, written
from .exact_dedup import normalised

CAPACITY = 8192
SHARD_ROWS = 2048


def duplicate_cluster(text: Column) -> Column:
    """Texts that operator 2 calls equal (all but blanks) share a cluster."""
    return F.xxhash64(normalised(text))


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster), in their order; bins count from 0.
    None conflicts with nothing."""
    bit_of: dict = {}
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        length, source, cluster = items[i]
        s = 0 if source is None else 1 << bit_of.setdefault(("s", source), len(bit_of))
        c = 0 if cluster is None else 1 << bit_of.setdefault(("c", cluster), len(bit_of))
        at = bisect_left(room, (length, -1))
        while at < len(room) and (sources[room[at][1]] & s or clusters[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
            sources[b] |= s
            clusters[b] |= c
        else:
            left, b = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        out[i] = (b, capacity - left)
        if left > length:
            insort(room, (left - length, b))
    return out


def _pack(capacity: int):
    fit = best_fit

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("rid")
        none = lambda v: None if pd.isna(v) else v
        items = [(int(n), none(s), none(c)) for n, s, c in zip(shard["length"], shard["source"], shard["cluster"])]
        where = fit(items, capacity)
        base = int(shard["shard"].iloc[0]) << 32
        return pd.DataFrame({"rid": shard["rid"], "bin_id": [base + b for b, _ in where],
                             "bin_offset": [o for _, o in where]})
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", shard_rows: int = SHARD_ROWS, cluster_col: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, bin_id, bin_offset, source, cluster``.

    ``start`` and ``length`` are code points of the text.  Pieces of full capacity have a bin of their
    own.  Null and empty texts give one row of length 0 without a bin.  A null source conflicts with none.
    Repeated rows are documents of their own (copies, so never in one bin).  No rows from an empty table.
    ``cluster_col`` names the duplicate clusters, such as ``class_id`` of ``near_dedup``; rows without one, and all
    rows by default, are clustered by ``duplicate_cluster``."""
    n = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    cluster = duplicate_cluster(F.col(text_col))
    if cluster_col:  # the word keeps given names apart from those by text
        given = F.xxhash64(F.lit("cluster"), F.col(cluster_col).cast("string"))
        cluster = F.when(F.col(cluster_col).isNull(), cluster).otherwise(given)
    names = dict.fromkeys([id_col, text_col, source_col, *([cluster_col] if cluster_col else [])])
    thin = pick(docs, *names).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"),
        n.alias("n"))
    root = work_dir(docs.sparkSession, "packing")
    thin = written(thin, f"{root}/documents")
    full = F.floor(F.col("n") / capacity)
    whole = (thin.where(F.col("n") >= capacity)
             .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)))
             .select("id", "piece", (F.col("piece") * capacity).alias("start"),
                     F.lit(capacity).cast("long").alias("length"),
                     # odd numbers below zero, apart from every shard's bins
                     (-(F.xxhash64("rid", "piece").bitwiseAND(F.lit(2 ** 62 - 1))) - 1).alias("bin_id"),
                     F.lit(0).cast("long").alias("bin_offset"), "source", "cluster"))
    rest = thin.withColumn("length", F.col("n") % capacity).where("length > 0")
    shards = max(1, -(-rest.count() // shard_rows))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    placed = rest.select("rid", "length", "source", "cluster", "shard").groupBy("shard").applyInPandas(
        _pack(capacity), "rid long, bin_id long, bin_offset long")
    rest = rest.join(placed, "rid").select(
        "id", full.alias("piece"), (full * capacity).alias("start"), "length", "bin_id", "bin_offset", "source",
        "cluster")
    none = thin.where("n = 0").select(
        "id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("long").alias("bin_offset"), "source", "cluster")
    return whole.unionByName(rest).unionByName(none).withColumnRenamed("id", id_col)
