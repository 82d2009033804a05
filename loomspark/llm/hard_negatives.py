"""Hard negatives by threshold joins in the manner of L2AP.

An anchor's positives are its nearest rows of the same label; the hard negatives of a positive are the
nearest rows of other labels whose score lies in a window below the positive's.  Both are threshold
joins: find every row whose score reaches a threshold that differs from anchor to anchor.

Rows lie in blocks of about ``BLOCK_ROWS``, in the order of label and norm; anchors in parts of at most
``PART_ROWS``.  A part meets a block unless the product of norms keeps all its anchors below their thresholds.
In a task an inverted index of the block lists, for each group of dimensions (those with most energy
first), the rows that need it: a row is not listed under the dimensions at its end whose norm, times
the largest norm of the anchors' ends, stays below the least threshold.  Partial scores are accumulated
list by list; after each, pairs go that the norms of what remains cannot lift to the threshold.  What
is left is completed from the vectors themselves, exactly.

The first thresholds are read off a bounded sample of rows; anchors whose windows are not full go on
with lower ones, and with none after ``ROUNDS`` rounds.  The sample decides only how much work is done.
A block returns at most ``need`` rows for each window of an anchor.

Scores are sums of products of whole numbers, kept exactly: components are ``floor(scale * x)``.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, pick, work_dir, written

BLOCK_ROWS = 8192
PART_ROWS = 4096
SAMPLE_ROWS = 4096
#: Rows that the first thresholds should let through; each round has eight times as many.
FIRST = 24
ROUNDS = 3
DIMS = 8
SLICE = 512
NONE = -(1 << 62)


def quantised(vec: Column, scale: int) -> Column:
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """``id, label, vec`` of the distinct rows that take part."""
    v = F.col("vec")
    src = pick(rows, id_col, vec_col, label_col).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"))
    return (src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0)
                      & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
            .select("id", "label", quantised(v, scale).alias("vec")).distinct())


def survivors(a: np.ndarray, y: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j) with a[i] . y[j] >= least[i], and their scores: the indexed search described above.
    Whole numbers; dimensions in the order in which lists are read, ``width`` in each."""
    dim = a.shape[1]
    cuts = list(range(0, dim, width)) + [dim]
    tail = lambda x: np.stack([np.sqrt((x[:, c:] ** 2).sum(axis=1)) for c in cuts], axis=1)
    ta, ty = tail(a), tail(y)
    slack = 1 - 1e-9 if least.min() > 0 else 1.0
    # the first list that a row can do without, with all after it
    free = ta.max(axis=0)[None, :] * ty < least.min() * slack
    n_lists = np.where(free.any(axis=1), free.argmax(axis=1), len(cuts) - 1)
    scores = np.zeros((len(a), len(y)))
    alive = np.arange(len(y))[n_lists > 0]
    for c in range(len(cuts) - 1):
        listed = alive[n_lists[alive] > c]
        if not len(listed):
            break
        scores[:, listed] += a[:, cuts[c]:cuts[c + 1]] @ y[listed, cuts[c]:cuts[c + 1]].T
        rest = np.minimum(n_lists[alive], c + 1)  # what a row has been read to
        reach = scores[:, alive] + ta[:, np.arange(len(cuts))][:, rest] * ty[alive, rest][None, :]
        keep = (reach * (1 + 1e-9) + 1e-6 >= least[:, None]).any(axis=0)
        alive = alive[keep]
    if not len(alive):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    rest = n_lists[alive]
    reach = scores[:, alive] + ta[:, rest] * ty[alive, rest][None, :]
    i, j = np.nonzero(reach * (1 + 1e-9) + 1e-6 >= least[:, None])
    at = alive[j]
    out = scores[i, at]
    for c in np.unique(n_lists[at]):  # completed from the vectors where lists were left out
        if c < len(cuts) - 1:
            m = np.flatnonzero(n_lists[at] == c)
            out[m] += np.einsum("nd,nd->n", a[i[m], cuts[c]:], y[at[m], cuts[c]:])
    ok = out >= least[i]
    return i[ok], at[ok], out[ok]


def _search(need: int, same: bool, order: np.ndarray):
    """cogroup function: of anchors and a block the rows that reach the thresholds, at most ``need`` for each window.
    Anchors have windows (low, high) of scores; ``same`` asks for their own label, else for others."""
    width, step, fields = DIMS, SLICE, ["aid", "rid", "id", "score"]
    find = survivors

    def run(anchors: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(base):
            y = np.stack(base["vec"].to_numpy())[:, order].astype(np.float64)
            label, rid, ids = (base[c].to_numpy() for c in ("label", "rid", "id"))
            by_label = anchors.sort_values("label", kind="stable")
            a_all = np.stack(by_label["vec"].to_numpy())[:, order].astype(np.float64)
            least_all, own_all, aid_all = (by_label[c].to_numpy() for c in ("least", "label", "aid"))
            windows = by_label["windows"].to_numpy()
            for s in range(0, len(a_all), step):
                least, own, aid = (x[s:s + step] for x in (least_all, own_all, aid_all))
                wanted = np.flatnonzero(np.isin(label, own)) if same else np.arange(len(y))
                if not len(wanted):
                    continue
                i, j, score = find(a_all[s:s + step], y[wanted], least.astype(np.float64), width)
                j = wanted[j]
                ok = (label[j] == own[i]) == same
                ok &= rid[j] != aid[i]
                i, j, score = i[ok], j[ok], score[ok].astype(np.int64)
                first = np.lexsort((rid[j], ids[j], -score, i))
                i, j, score = i[first], j[first], score[first]
                ends = np.searchsorted(i, np.arange(len(aid) + 1))
                for k in range(len(aid)):
                    lo, hi = ends[k], ends[k + 1]
                    if lo == hi:
                        continue
                    down = -score[lo:hi]
                    keep = set()
                    for w in windows[s + k]:
                        x = int(np.searchsorted(down, -w["high"]))
                        z = int(np.searchsorted(down, -w["low"], side="right"))
                        keep.update(range(lo + x, lo + min(z, x + need)))
                    at = np.fromiter(keep, int, len(keep))
                    out.append(pd.DataFrame({"aid": aid[k], "rid": rid[j[at]], "id": ids[j[at]], "score": score[at]}))
        return pd.concat(out)[fields] if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in fields})
    return run


def _thresholds(sample: dict, same: bool, total: int, rows: int):
    """Function over batches of (aid, label, vec, windows): the threshold that should let about ``rows`` rows
    through below the top of the lowest window.  Not below the windows' ends."""
    x, label, have = sample["x"], sample["label"], len(sample["x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own, vec, windows in zip(b.column("label").to_pylist(), b.column("vec").to_pylist(),
                                         b.column("windows").to_pylist()):
                s = x[(label == own) == same] @ np.array(vec, np.float64)
                share = rows * have / total  # of the sample's rows, as many stand for ``rows``
                s = -np.sort(-s)
                top = min(w["high"] for w in windows)
                start = int(np.searchsorted(-s, -top, side="left"))
                at = start + share
                if not len(s) or at >= len(s):
                    t = NONE
                elif at >= 1:
                    before = min(float(top), s[int(at) - 1])
                    t = before - (at - int(at)) * (before - s[int(at)])
                else:  # beyond the sample: as in the tail of a normal distribution
                    far = NormalDist().inv_cdf(1 - min(0.5, rows / max(total * len(s) / have, 2 * rows)))
                    t = min(float(top), max(float(s[0]), float(s.mean()) + far * float(s.std())))
                end = min(w["low"] for w in windows)
                out.append(max(end, math.floor(t) if t > NONE else NONE))
            yield pa.RecordBatch.from_arrays([b.column("aid"), pa.array(out, pa.int64())], names=["aid", "least"])
    return run


def _join(live: DataFrame, base: DataFrame, blocks: DataFrame, n_live: int, same: bool, need: int,
          order: np.ndarray) -> DataFrame:
    """(aid, rid, id, score): live anchors against the blocks that can hold what they look for."""
    parts = max(1, -(-n_live // PART_ROWS))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, c: s + c * c))
    asked = live.select("aid", "label", "vec", "least", "windows", F.pmod(F.xxhash64("aid"), F.lit(parts)).alias("part"),
                        norm.alias("length"))
    n_blocks = blocks.count()
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    has = F.col("label").between(F.col("l0"), F.col("l1"))
    only = (F.col("label") == F.col("l0")) & (F.col("label") == F.col("l1"))
    asked = asked.join(blocks, "block").where((has if same else ~only) & (
        F.col("length") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least"))).drop("l0", "l1", "longest", "length")
    copies = base.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return (asked.groupBy("block", "part").cogroup(copies.groupBy("block", "part"))
            .applyInPandas(_search(need, same, order), "aid long, rid long, id long, score long"))


def _filled(anchors: DataFrame, same: bool, need: int, found_in: dict, root: str) -> DataFrame:
    """Rows (aid, rid, id, score) that hold, for each window of each anchor, its first ``need`` rows: thresholds go
    down for anchors whose windows are not full."""
    live, done = anchors, None
    for r in range(ROUNDS + 1):
        n_live = live.count()
        if not n_live:
            break
        if r < ROUNDS:
            rule = _thresholds(found_in["sample"], same, found_in["total"], FIRST * 8 ** r)
            least = live.select("aid", "label", "vec", "windows").mapInArrow(rule, "aid long, least long")
        else:
            least = live.select("aid", F.array_min(F.transform("windows", lambda w: w["low"])).alias("least"))
        now = written(live.join(least, "aid"), f"{root}/live-{r}")
        got = written(_join(now, found_in["base"], found_in["blocks"], n_live, same, need, found_in["order"]),
                      f"{root}/found-{r}")
        per = (now.select("aid", "least", F.explode("windows").alias("w")).join(got.select("aid", "score"), "aid", "left")
               .groupBy("aid", "w", "least").agg(F.count_if(F.col("score").between(F.col("w.low"), F.col("w.high"))).alias("n")))
        short = per.where((F.col("n") < F.col("w.want")) & (F.col("least") > F.col("w.low"))).select("aid").distinct()
        short = written(short, f"{root}/short-{r}")
        ready = got.join(short, "aid", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        live = live.join(short, "aid", "left_semi")
    return done


def mine(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         every: int = 100, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
         scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (id divisible
    by ``every``) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels with window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score.  Higher
    scores come first, ties go to the smaller id.

    Rows with a null id or label, a null or empty vector, a null or non-finite component, or another length
    than most take no part.  Rows repeated with id, label and vector count once; of different rows
    with one id each is a row of its own.  An anchor without another row of its label, or whose positives have
    negative scores, has no result; an empty table gives no rows.  Vectors whose squared norm reaches 2**52
    after scaling are refused with a ValueError, since their scores would not be exact."""
    spark = rows.sparkSession
    root = work_dir(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    clean = written(usable(rows, id_col, vec_col, label_col, scale), f"{root}/clean")
    sizes = clean.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["dim"]
    square = F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    ordered = in_order(clean.where(F.size("vec") == dim).withColumn("square", square), f"{root}/order",
                       F.col("label"), F.col("square").desc(), F.col("id"), F.xxhash64("vec"))
    base = ordered.select(F.col("pos").alias("rid"), "id", "label", "vec", "square",
                          F.floor(F.col("pos") / BLOCK_ROWS).alias("block"))
    energy = base.select(*[F.avg(F.col("vec")[i].cast("double") ** 2).alias(f"e{i}") for i in range(dim)],
                         F.max("square").alias("top"), F.count(F.lit(1)).alias("n")).first()
    if energy["top"] >= 2.0 ** 52:
        raise ValueError("vectors are too long for exact scores: squared norm of 2**52 or more after scaling")
    blocks = written(base.groupBy("block").agg(F.min("label").alias("l0"), F.max("label").alias("l1"),
                                               F.sqrt(F.max("square")).alias("longest")), f"{root}/blocks")
    some = base.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE_ROWS).select("label", "vec").collect()
    sample = {"x": np.array([r["vec"] for r in some], np.float64), "label": np.array([r["label"] for r in some])}
    found_in = {"base": base.drop("square"), "blocks": blocks, "sample": sample, "total": energy["n"],
                "order": np.argsort([-energy[f"e{i}"] for i in range(dim)], kind="stable")}

    others = base.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("others"))
    want = lambda low, high, n: F.struct(
        low.cast("long").alias("low"), high.cast("long").alias("high"), n.cast("long").alias("want"))
    anchors = (base.where(F.pmod("id", F.lit(every)) == 0).select(F.col("rid").alias("aid"), F.col("id").alias("anchor_id"),
                                                                  "label", "vec")
               .join(others, "label").where("others > 0"))
    anchors = written(anchors.withColumn("windows", F.array(want(
        F.lit(NONE), F.lit(-NONE), F.least(F.lit(positives), "others")))), f"{root}/anchors")
    same = _filled(anchors, True, positives, found_in, f"{root}/same")
    if same is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("aid").orderBy(F.desc("score"), "id", "rid")
    pos = written(same.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives).select(
        "aid", F.col("id").alias("positive_id"), F.col("rid").alias("pid"), F.col("score").alias("positive_score")),
        f"{root}/positives")
    # whole scores s with window[0] * p <= 100 * s <= window[1] * p
    low = F.expr(f"-((-positive_score * {int(window[0])}) div 100)")
    low = low + F.when(low * 100 < F.col("positive_score") * window[0], 1).otherwise(0)
    high = F.floor(F.col("positive_score") * window[1] / F.lit(100))
    spans = (pos.select("aid", want(low, high, F.lit(negatives)).alias("w")).where("w.low <= w.high").distinct()
             .groupBy("aid").agg(F.array_sort(F.collect_list("w")).alias("windows")))
    seekers = written(anchors.drop("windows").join(spans, "aid"), f"{root}/seekers")
    other = _filled(seekers, False, negatives, found_in, f"{root}/other")
    if other is None:
        return spark.createDataFrame([], schema)
    rank = Window.partitionBy("aid", "pid").orderBy(F.desc("score"), "id", "rid")
    return (pos.join(other, "aid").where((F.col("score") * 100 >= F.col("positive_score") * window[0])
                                         & (F.col("score") * 100 <= F.col("positive_score") * window[1]))
            .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives)
            .join(anchors.select("aid", "anchor_id"), "aid")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
