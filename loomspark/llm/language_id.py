"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed letter trigrams (lower case, other characters are word breaks),
weighted by log counts and inverse document frequency and scaled to length 1.  Each language has a
few centroids from spherical k-means; the largest cosine names the language.  Cosines grow with the
size of a text and differ from language to language, so a text is rejected if its cosine is below
``REJECT_SHARE`` of a low quantile of what training texts, or excerpts of training texts if those reach less,
of its length class have that are taken for the same language.  One rule holds for all sizes.

Everything is learnt from every training text of the ``MAX_LANGUAGES`` languages with most of them.  Trigrams are
counted once and written.  Each round of k-means assigns all texts to the centroids of their language and
adds them up, in whole numbers, so that no order of the sums matters; only where the rounds begin comes from
a bounded sample of each language.  Floors count the cosines of all texts in bins, and those of excerpts: one of every
text, of a length by its hash, and one of each length from some texts of each language and length, so that
rare lengths have them too.  A sample takes rows in the order of a hash of their content and place.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, held_out, located, map_texts, pick, small, work_dir, written

DIMS_LOG2 = 15
SAMPLE_ROWS = 400
#: Languages that a model knows at most: those with most training texts (centroids are collected).
MAX_LANGUAGES = 256
CLUSTERS = 4
ROUNDS = 12
#: A text is rejected below this share of this quantile of the cosines of its length class and language: of
#: training texts, or of excerpts if that is lower; of all languages where a language has fewer than
#: ``LEAST_ROWS``; of the next smaller class that has a floor, else LEAST_COSINE.
REJECT_SHARE = 0.5
QUANTILE = 0.005
LEAST_ROWS = 20
LEAST_COSINE = 0.02
EXCERPT_CHARS = (12, 25, 50, 100, 200, 400, 800, 3200, 12_800)
#: Trigrams of texts that are worked on at a time (about).
ENTRIES = 1 << 18
#: Weights are added up as whole numbers of this share, cosines are counted in bins of that width.
WEIGHT_SCALE = 1 << 20
BINS = 1 << 16
#: Languages whose sums a task holds.
HELD_LANGUAGES = 32


def counter():
    """Function from a text to its hashed trigrams, their counts and whether it has a letter."""
    letters = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x34000)), bool)
    bits = np.uint32(32 - DIMS_LOG2)
    none = np.zeros(0, np.int64), np.zeros(0, np.float32)
    k1, k2, k3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)

    def count(text: str):
        a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[np.minimum(a, 0x33FFF)]
        a = np.concatenate(([32], np.where(is_letter, a, 32), [32])).astype(np.uint32)
        space = a == 32
        a = a[~(space & np.concatenate(([False], space[:-1])))]
        if len(a) < 3:
            return *none, bool(is_letter.any())
        h = a[:-2] * k1 + a[1:-1] * k2 + a[2:] * k3
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        dims, counts = np.unique((h >> bits).astype(np.uint16), return_counts=True)
        return dims.astype(np.int64), counts.astype(np.float32), bool(is_letter.any())
    return count


def weights(dims: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The text's vector at its dimensions, scaled to length 1."""
    v = np.log1p(counts) * idf[dims]
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def length_class(n: int) -> int:
    """Texts are alike in size if their numbers of different trigrams have the same power of two."""
    return int(math.log2(1 + n))


def _parts(dims: pa.ListArray, counts: pa.ListArray) -> Iterator[tuple]:
    """Of lists, none empty, runs of about ``ENTRIES`` entries: first and last row, starts of rows, dimensions, counts."""
    ends, d, c = dims.offsets.to_numpy(), dims.values.to_numpy(), counts.values.to_numpy()
    shift = int(counts.offsets[0].as_py()) - int(ends[0])
    first = 0
    while first < len(dims):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + ENTRIES, "right")) - 1)
        i, j = ends[first], ends[last]
        yield first, last, ends[first:last] - i, d[i:j].astype(np.int64), c[i + shift:j + shift]
        first = last


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """Of each dimension the texts that have it: one partial sum per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << DIMS_LOG2, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=len(total))
        dims = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(total[dims], pa.int64())], names=["dim", "n"])
    sums = texts.select("dims").mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(1 << DIMS_LOG2, np.float64)  # at most 2**DIMS_LOG2 rows
    df[sums["dim"].to_numpy()] = sums["n"].to_numpy()
    return df


def _sums(idf: np.ndarray, centres: np.ndarray):
    """mapInArrow function: rows (no, dims, counts) added up by the nearest centroid of their language, the ``no``-th."""
    langs, k, size = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = centres.reshape(-1)
        held: dict[int, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang * k + at // size, pa.int32()), pa.array(at % size, pa.int32()), pa.array(total[at])],
                    names=["centre", "dim", "n"])
            held.clear()
        for b in batches:
            no = b.column(0).to_numpy().astype(np.int64)
            for first, last, starts, dims, counts in _parts(b.column(1), b.column(2)):
                often = np.diff(np.append(starts, len(dims)))
                w = np.log1p(counts) * idf[dims]
                w /= np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), often)
                own = np.repeat(no[first:last] * (k * size), often) + dims
                near = np.argmax([np.add.reduceat(w * flat[own + j * size], starts) for j in range(k)], axis=0)
                lang, at = np.repeat(no[first:last], often), np.repeat(near, often) * size + dims
                whole = np.rint(w * WEIGHT_SCALE).astype(np.int64)
                for x in np.unique(no[first:last]).tolist():
                    mine = lang == x
                    np.add.at(held.setdefault(x, np.zeros(k * size, np.int64)), at[mine], whole[mine])
            if len(held) > HELD_LANGUAGES:
                yield from rows()
        yield from rows()
    return run


def _refined(texts: DataFrame, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Spherical k-means over all rows (no, dims, counts) from the centroids by language, place and dimension, in at
    most ``ROUNDS`` rounds, until none changes it.  A centroid that no text is nearest to stays."""
    texts = texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)  # each task returns sums of all centroids
    for _ in range(ROUNDS):
        got = (texts.mapInArrow(_sums(idf, centres), "centre int, dim int, n long").groupBy("centre", "dim")
               .agg(F.sum("n").alias("n")).toArrow())  # 2**DIMS_LOG2 rows for each centroid at most
        new = np.zeros((centres.shape[0] * centres.shape[1], centres.shape[2]), np.float32)
        at = got["centre"].to_numpy()
        n = got["n"].to_numpy().astype(np.float64)
        lengths = np.sqrt(np.bincount(at, n * n, minlength=len(new)))
        new[at, got["dim"].to_numpy()] = n / lengths[at]
        new = np.where(lengths[:, None] > 0, new, centres.reshape(new.shape)).reshape(centres.shape)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def _cluster(idf: np.ndarray):
    """applyInPandas function: where the centroids of one language begin, from the trigram counts of its sample."""
    k, rounds, dims = CLUSTERS, ROUNDS, 1 << DIMS_LOG2

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        x = np.zeros((len(group), dims), np.float32)
        for row, at, n in zip(x, group["dims"], group["counts"]):
            row[at] = weights(at, n, idf)
        centres = [x[0]]
        while len(centres) < min(k, len(x)):  # the text farthest from all centres so far
            far = int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))
            centres.append(x[far])
        c = np.array(centres)
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1)
            for j in range(len(c)):
                if (near == j).any():
                    m = x[near == j].sum(axis=0)
                    c[j] = m / max(float(np.sqrt(m @ m)), 1e-12)
        at = [np.flatnonzero(r) for r in c]
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(c), "dims": [a.astype(np.int32).tobytes() for a in at],
                             "weights": [r[a].tobytes() for r, a in zip(c, at)]})
    assert dims == len(idf)
    return run


def _counts():
    """Function for map_texts: the trigrams of texts and their counts."""
    def make():
        count = counter()

        def work(texts):
            out = [count(t)[:2] for t in texts]
            return [[a for a, _ in out], [n for _, n in out]]
        return work
    return make


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Learn from the texts with a language outside the held-out fold.  Without any the model knows no language.

    Null texts and languages teach nothing; repeated rows, also with null ids, are rows of their own, and the
    bounds of the samples hold for rows; texts of any length are read whole; ties of the sample's hash go by place."""
    spark = docs.sparkSession
    root = work_dir(spark, "language-id")
    src = (located(docs, [id_col, text_col, lang_col], f"{root}/input").toDF("id", "text", "lang", "file", "row")
           .where("text is not null and lang is not null").where(~held_out(F.col("id"))))
    src = src.select("lang", "file", "row", F.xxhash64("id", "text", "row").alias("h"),
                     F.floor(F.log2(F.char_length("text"))).alias("size"), "text")
    counted = written(map_texts(src, _counts(), "dims array<int>, counts array<float>"), f"{root}/trigrams")
    texts = counted.where(F.size("dims") > 0)
    idf = (np.log((counted.count() + 1) / (_document_frequencies(texts) + 1)) + 0.1).astype(np.float32)
    often = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    langs = sorted(r["lang"] for r in often)
    known = spark.createDataFrame(list(zip(langs, range(len(langs)))), "lang string, no int")
    texts = texts.join(F.broadcast(known), "lang")  # MAX_LANGUAGES rows
    rows = texts.select("lang", "file", "row", "h", "size")

    def chosen(keys: list[str], name: str) -> DataFrame:
        out = written(bounded_sample(rows, keys, SAMPLE_ROWS, "h", "file", "row").select("file", "row"), f"{root}/{name}")
        return small(out, out.count(), 250)
    begun = (texts.join(chosen(["lang"], "sample"), ["file", "row"]).select("lang", "dims", "counts", "h")
             .groupBy("lang").applyInPandas(_cluster(idf), "lang string, dims binary, weights binary").collect())
    begun.sort(key=lambda r: (r["lang"], bytes(r["dims"]), bytes(r["weights"])))
    centres = np.zeros((len(langs), CLUSTERS, 1 << DIMS_LOG2), np.float32)
    used = dict.fromkeys(langs, 0)
    for r in begun:
        c = centres[langs.index(r["lang"]), used[r["lang"]]]
        c[np.frombuffer(bytes(r["dims"]), np.int32)] = np.frombuffer(bytes(r["weights"]), np.float32)
        used[r["lang"]] += 1
    if begun:
        centres = _refined(texts.select("no", "dims", "counts"), idf, centres)
    model = {"idf": idf, "langs": [x for x in langs for _ in range(used[x])],
             "centres": np.concatenate([np.zeros((0, 1 << DIMS_LOG2), np.float32),
                                        *[c[:used[x]] for x, c in zip(langs, centres)]])}
    like = chosen(["lang", "size"], "like").withColumn("all", F.lit(True))
    parts = src.join(F.broadcast(known), "lang").join(like, ["file", "row"], "left").select("h", "text", "all")
    model["floors"] = _floors(model, texts.select("dims", "counts"), parts, root) if begun else {}
    return model


def _floors(model: dict, texts: DataFrame, sources: DataFrame, root: str) -> dict:
    """Floors by (language, length class), and of all languages by (None, length class), from the trigrams of texts
    and from excerpts of ``sources`` (h, text, all): of every length if ``all``, else of one by hash."""
    def judged(nearest, at, n):
        near, cos = nearest(at, n)
        return model["langs"][near], length_class(len(at)), int(cos * BINS)

    def make():
        count, nearest = counter(), _nearest(model)

        def work(texts):
            out = []
            for t in texts:
                at, n, _ = count(t)
                out.append(judged(nearest, at, n) if len(at) else (None, None, None))
            return list(zip(*out)) or [[], [], []]
        return work

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _nearest(model)
        for b in batches:
            out = []
            for first, last, starts, dims, counts in _parts(b.column(0), b.column(1)):
                out += [judged(nearest, at, n) for at, n in zip(np.split(dims, starts[1:]), np.split(counts, starts[1:]))]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], pa.int32())], names=["near", "k", "bin"])
    spot = lambda n: F.pmod(F.xxhash64("h", F.lit(n)), F.char_length("text") - F.lit(n) + 1).cast("int") + 1
    turn = F.pmod("h", F.lit(len(EXCERPT_CHARS)))
    parts = sources.select(F.explode(F.array(*[
        F.when((F.col("all") | (turn == i)) & (F.char_length("text") >= n), F.substring(F.col("text"), spot(n), F.lit(n)))
        for i, n in enumerate(EXCERPT_CHARS)])).alias("text")).where("text is not null")
    fields = "near string, k int, bin int"
    seen = (texts.mapInArrow(whole, fields).withColumn("part", F.lit(False))
            .unionByName(map_texts(parts, make, fields).where("k is not null").withColumn("part", F.lit(True))))
    bins = written(seen.groupBy("part", "near", "k", "bin").agg(F.count(F.lit(1)).alias("n")), f"{root}/bins")
    bins = bins.unionByName(bins.groupBy("part", "k", "bin").agg(F.sum("n").alias("n")).withColumn("near", F.lit(None).cast("string")))
    group = Window.partitionBy("part", "near", "k")  # at most BINS + 1 rows
    low = (bins.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)})
           .where((F.col("total") >= LEAST_ROWS) & (F.col("upto") > F.lit(QUANTILE) * (F.col("total") - 1)))
           .groupBy("part", "near", "k").agg((F.min("bin") / F.lit(BINS)).alias("q")))
    out: dict = {}
    for r in low.collect():  # two rows for each known language and length class
        key = r["near"], r["k"]
        out[key] = min(out.get(key, math.inf), REJECT_SHARE * r["q"])
    return out


def _nearest(model: dict):
    """Function from trigrams and counts to the number of the nearest centroid and its cosine."""
    idf, centres = model["idf"], model["centres"]

    def nearest(at: np.ndarray, n: np.ndarray) -> tuple[int, float]:
        cos = centres[:, at] @ weights(at, n, idf)
        near = int(np.argmax(cos))
        return near, min(1.0, max(0.0, float(cos[near])))
    return nearest


def _judge(model: dict):
    """Function from a text to (language, score, accepted)."""
    count = counter()
    langs, floors, nearest = model["langs"], model["floors"], _nearest(model)

    def judge(text: str) -> tuple[str, float, bool]:
        at, n, letter = count(text)
        if not letter or not langs:
            return "und", 0.0, False
        near, best = nearest(at, n)
        least = LEAST_COSINE
        for k in range(length_class(len(at)), -1, -1):
            found = floors.get((langs[near], k), floors.get((None, k)))
            if found is not None:
                least = found
                break
        return langs[near], best, best >= least
    return judge


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected (null counts as empty and is).
    Repeated rows stay or go together; texts of any length are read whole."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def keep(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = _judge(model)
        for batch in texts:
            yield batch.map(lambda t: judge(t)[2])
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    return docs.toDF(*names).where(keep(F.coalesce(text, F.lit("")))).toDF(*docs.columns)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, accepted`` and the columns of ``keep``.
    Score is the cosine to the nearest centroid (0 to 1; ties: first language by name).  ``und`` with score 0
    for null texts, texts without a letter, or a model without languages; ``und`` is never accepted.  Repeated rows
    are rows of their own; texts of any length are read whole; an empty table gives no rows."""
    src = pick(docs, id_col, text_col, *keep)
    src = src.toDF("id", "text", *src.columns[2:]).withColumn("text", F.coalesce("text", F.lit("")))
    def make():
        judge = _judge(model)
        return lambda texts: list(zip(*map(judge, texts))) or [[], [], []]
    out = map_texts(src, make, "lang_pred string, score double, accepted boolean")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score",
                      "accepted", *keep)
