"""Quality scores from compression.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled
bad.  A text is compressed in blocks under each dictionary; the difference of the two sizes over
their sum says which labelled texts it resembles, and a logistic curve turns it into a score.

What is learned comes from a bounded sample of labelled rows: per label at most ``SAMPLE_ROWS``
rows for the dictionaries and as many others for the curve, in the order of a hash of their content and
place.  A dictionary is trained on whole texts of up to ``TEXT_BLOCKS`` blocks, and on as many blocks of a
longer one, chosen by hash; the curve and every score see whole texts.
"""
from __future__ import annotations

import math
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, located, map_texts, pick, small, work_dir, written

SAMPLE_ROWS = 1500
TEXT_BLOCKS = 10
DICT_BYTES = 64 << 10
BLOCK_BYTES = 4096
LEVEL = 3


def _blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


def _chosen_blocks():
    """Function for map_texts: a text's blocks, of a long one those with the smallest hashes."""
    most = TEXT_BLOCKS

    def make():
        def work(texts):
            out = []
            for t in texts:
                found = _blocks(t)
                if len(found) > most:
                    at = sorted(range(len(found)), key=lambda i: (xxhash.xxh64_intdigest(found[i], i), i))[:most]
                    found = [found[i] for i in sorted(at)]
                out.append(found)
            return [out]
        return work
    return make


def _train(group: pd.DataFrame) -> pd.DataFrame:
    import zstandard as zstd
    pieces = [bytes(b) for blocks in group.sort_values("h")["blocks"] for b in blocks]
    try:
        made = zstd.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself is the dictionary
        made = b"".join(pieces)[:DICT_BYTES]
    return pd.DataFrame({"label": [int(group["label"].iloc[0])], "dictionary": [made]})


def _difference(good: bytes, bad: bytes):
    """Function for map_texts: x, the normalised difference of compressed sizes (0 for empty texts)."""
    block, level = BLOCK_BYTES, LEVEL

    def make():
        import zstandard as zstd
        press = []
        for raw in (good, bad):
            d = zstd.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            press.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        g, b = press

        def work(texts: list[str]):
            xs = []
            for t in texts:
                data = t.encode("utf-8", "surrogatepass")
                sg = sb = 0
                for i in range(0, len(data), block):
                    piece = data[i:i + block]
                    sg += len(g.compress(piece))
                    sb += len(b.compress(piece))
                xs.append((sb - sg) / (sb + sg) if data else 0.0)
            return [xs]
        return work
    return make


def _logistic(points: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve (Newton steps with a small ridge)."""
    scale = max((abs(x) for x, _, _ in points), default=1.0) or 1.0
    a = b = 0.0
    for _ in range(60):
        ga, gb, haa, hab, hbb = -1e-4 * a, 0.0, 1e-4, 0.0, 1e-9
        for x, y, w in points:
            z = x / scale
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * z + b))))
            v = w * p * (1 - p)
            ga, gb = ga + w * (y - p) * z, gb + w * (y - p)
            haa, hab, hbb = haa + v * z * z, hab + v * z, hbb + v
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a / scale, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> dict:
    """Learn from labelled rows outside the held-out fold.  The model is a small dict: two dictionaries of
    at most ``DICT_BYTES`` and the curve.  Without labels of both kinds it scores every text with the
    share of label 1 (0.5 if there are no labels).

    An id with several labels counts as 1; null ids have no label; null and empty texts teach nothing.  Rows that
    repeat an id are rows of their own, and the bounds hold for rows; ties of the hash go by place; equal scores of
    the curve's texts share its value there.  Texts of any length take part."""
    root = work_dir(docs.sparkSession, "quality")
    known = (pick(labels, id_col, label_col).toDF("id", "label").where("id is not null and label in (0, 1)")
             .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").cast("int").alias("label")))
    src = located(docs, [id_col, text_col], f"{root}/input").toDF("id", "text", "file", "row").where(
        F.char_length("text") > 0)
    rows = src.select("id", "file", "row", F.xxhash64("id", "text", "row").alias("h")).join(known, "id")
    rows = written(rows.select("file", "row", "label", "h", F.pmod(F.col("h"), F.lit(2)).cast("int").alias("part")), f"{root}/rows")
    # the first bit of the hash has chosen the part
    chosen = written(bounded_sample(rows.withColumn("h", F.shiftright("h", 1)), ["label", "part"], SAMPLE_ROWS, "h", "file", "row"),
                     f"{root}/chosen")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = total.get(1, 0) / sum(total.values()) if total else 0.5
    sample = src.select("text", "file", "row").join(small(chosen, chosen.count(), 250), ["file", "row"])
    pieces = map_texts(sample.where("part = 0").select("text", "label", "h"), _chosen_blocks(), "blocks array<binary>")
    made = {r["label"]: bytes(r["dictionary"]) for r in pieces.groupBy("label").applyInPandas(
        _train, "label int, dictionary binary").collect()}
    if len(made) < 2:
        return {"good": b"", "bad": b"", "slope": 0.0, "intercept": _logit(prior)}
    seen = map_texts(sample.where("part = 1").select("text", "label"), _difference(made[1], made[0]),
                     "x double").collect()
    got = {k: sum(r["label"] == k for r in seen) for k in (0, 1)}
    if not all(got.values()):
        return {"good": b"", "bad": b"", "slope": 0.0, "intercept": _logit(prior)}
    weight = {k: total[k] / got[k] / sum(total.values()) * len(seen) for k in (0, 1)}
    slope, intercept = _logistic([(r["x"], r["label"], weight[r["label"]]) for r in seen])
    return {"good": made[1], "bad": made[0], "slope": slope, "intercept": intercept}


def _logit(p: float) -> float:
    return max(-30.0, min(30.0, math.log(p / (1 - p)))) if 0 < p < 1 else (30.0 if p else -30.0)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, size_difference``.  Null and empty texts
    have a size difference of 0.  Repeated rows are rows of their own; texts of any length are scored whole; equal
    texts have equal scores; an empty table gives no rows."""
    src = pick(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if model["good"]:
        out = map_texts(src, _difference(model["good"], model["bad"]), "x double")
    else:
        out = src.select("id", F.lit(0.0).alias("x"))
    z: Column = F.col("x") * model["slope"] + model["intercept"]
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
                      F.col("x").alias("size_difference"))
