import math
import random
import zlib

import zstandard

from loomspark.llm import quality


def rows(n=160):
    rnd = random.Random(1)
    words = ["stone", "river", "bright", "walk", "under", "lamp", "north", "garden", "quiet", "paper"]
    out = []
    for i in range(n):
        good = " ".join(rnd.choice(words) for _ in range(80)) + "."
        bad = " ".join(rnd.choice(words).upper() + "!!" for _ in range(80))
        out.append((i, good if i % 2 else bad))
    return out


def test_held_out_accuracy_and_edge_texts(spark, as_docs):
    data = rows()
    labels = spark.createDataFrame([(i, i % 2, None) for i, _ in data] + [(None, 1, 0), (5, None, 0), (3, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    docs = as_docs(data + [(900, None), (901, ""), (902, "w" * 200_000), (None, "River lamp"), (900, None)])
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(data) + 5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_no_labels_and_empty_tables(spark, as_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = quality.score(as_docs([(1, "a")]), quality.fit(as_docs([(1, "a")]), none)).collect()
    assert [(r.score, r.predicted) for r in out] == [(0.5, 1)]
    assert quality.score(as_docs([]), quality.fit(as_docs([]), none)).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.score(as_docs([(1, "a")]), quality.fit(as_docs([(1, "a")]), one)).first().predicted == 1


def test_equals_plain_compression(spark, as_docs):
    data = rows()
    labels = spark.createDataFrame([(i, i % 2) for i, _ in data], "doc_id bigint, quality int")
    docs = as_docs(data + [(900, None), (901, "q" * 9000), (902, "é" * 4097)])
    model = quality.fit(docs, labels)
    assert model["good"] and model["bad"]
    press = [zstandard.ZstdCompressor(quality.LEVEL, zstandard.ZstdCompressionDict(model[k]), write_content_size=False, write_dict_id=False)
             for k in ("good", "bad")]
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, text in [*data, (900, None), (901, "q" * 9000), (902, "é" * 4097)]:
        raw = (text or "").encode()
        good, bad = (sum(len(p.compress(raw[k:k + 4096])) for k in range(0, len(raw), 4096)) for p in press)
        x = (bad - good) / (bad + good) if raw else 0.0
        want = 1 / (1 + math.exp(-(x * model["slope"] + model["intercept"])))
        assert abs(got[i].size_difference - x) < 1e-12 and abs(got[i].score - want) < 1e-9


def test_labels_of_long_texts_and_repeated_ids(spark, as_docs, monkeypatch):
    good, bad = rows(2)[1][1], rows(2)[0][1]
    data = [(i, (good if i % 2 else bad) * 100) for i in range(60)] + [(7, good)] * 3000
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    seen = []
    whole = quality.bounded_sample

    def counted(*args):
        out = whole(*args)
        seen.append(out.groupBy("label", "part").count().agg({"count": "max"}).first()[0])
        return out
    monkeypatch.setattr(quality, "bounded_sample", counted)
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 50)
    model = quality.fit(as_docs(data), labels)
    assert seen == [50] and model["good"] and model["bad"]
    out = {r.doc_id: r.predicted for r in quality.score(as_docs([(1, good * 200), (2, bad * 200)]), model).collect()}
    assert out == {1: 1, 2: 0}
