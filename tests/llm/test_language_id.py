import math
import random

import numpy as np

from loomspark.llm import language_id


FOREIGN = "Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний"


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.identify(docs, language_id.fit(docs))
    held = out.where("held_out").join(docs, "doc_id").select("lang", "lang_pred", "accepted").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert sum(r.accepted for r in held) >= len(held)


def test_edge_texts(spark, sf, as_docs):
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "123 !!! 😀"), (4, "the and of"), (5, "the " * 100_000), (None, "the"),
            (6, FOREIGN), (6, FOREIGN)]
    out = {r.doc_id: r for r in language_id.identify(as_docs(rows), model).collect()}
    assert {i: out[i].lang_pred for i in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert out[4].lang_pred == "en" and out[5].lang_pred == "en" and out[None].lang_pred != "und"
    assert not out[6].accepted and out[6].lang_pred in ("de", "en", "es", "fr")
    assert all(0 <= r.score <= 1 for r in out.values())


ITALIAN = ("Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura ché la diritta via era smarrita ahi quanto a "
           "dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura").split()
DUTCH = ("Het was een mooie dag in het voorjaar en de vogels zongen in de bomen terwijl de kinderen buiten op straat speelden "
         "met hun nieuwe fietsen en hun ouders rustig een kopje koffie dronken in de kleine tuin achter het huis").split()
POLISH = ("Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność "
          "twą w całej ozdobie widzę i opisuję bo tęsknię po tobie panno święta co jasnej bronisz Częstochowy").split()


def test_short_foreign_and_junk_texts_are_rejected(spark, sf, as_docs):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")  # 100 texts teach too few trigrams
    model = language_id.fit(docs)
    rnd = random.Random(5)
    texts = [" ".join(w[i:i + n]) for w in (ITALIAN, DUTCH, POLISH) for n in (10, 15, 25, 40) for i in (0, 3, 6)
             if len(w) >= n + i]
    texts += [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
                       for _ in range(n)) for n in (10, 15, 25, 40) for _ in range(10)]
    out = language_id.identify(as_docs(list(enumerate(texts))), model).collect()
    assert [texts[r.doc_id] for r in out if r.accepted and len(texts[r.doc_id].split()) >= 25] == []
    assert sum(r.accepted for r in out) <= len(out) * 0.05  # ten or fifteen words may share trigrams by chance
    assert language_id.identify(docs.where("lang is not null"), model).where("not accepted").count() == 0


def test_nothing_to_learn_from(as_docs):
    docs = as_docs([(1, "abc"), (2, None)])
    out = language_id.identify(docs, language_id.fit(docs)).collect()
    assert [r.lang_pred for r in out] == ["und", "und"]
    assert language_id.identify(as_docs([]), language_id.fit(as_docs([]))).count() == 0


def plain_judge(model, text):
    """Nearest centroid and floor, one trigram after another."""
    text = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not text.strip():
        return "und", 0.0, False
    text = " ".join(["", *text.split(), ""])
    counts = {}
    for tri in zip(text, text[1:], text[2:]):
        h = sum(ord(c) * k for c, k in zip(tri, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))) % 2 ** 32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2 ** 32 >> 32 - language_id.DIMS_LOG2
        counts[h] = counts.get(h, 0) + 1
    v = np.zeros(1 << language_id.DIMS_LOG2)
    for h, n in counts.items():
        v[h] = math.log1p(n) * model["idf"][h]
    cos = model["centres"].astype(float) @ (v / max(np.sqrt(v @ v), 1e-12))
    best = int(np.argmax(cos))
    lang, size = model["langs"][best], int(math.log2(1 + len(counts)))
    floors = [model["floors"].get((lang, k), model["floors"].get((None, k))) for k in range(size, -1, -1)]
    least = next((f for f in floors if f is not None), language_id.LEAST_COSINE)
    return lang, min(1.0, max(0.0, float(cos[best]))), cos[best] >= least


def test_equals_plain_nearest_centroid(spark, sf, as_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    odd = [(10_000, None), (10_001, "?!"), (10_002, "a"), (10_003, FOREIGN), (10_004, "İstanbul ǅ ß"), (10_005, "x" * 300_000)]
    rows = [tuple(r) for r in docs.collect()] + odd
    got = {r.doc_id: r for r in language_id.identify(as_docs(rows), model).collect()}
    for i, text in rows:
        lang, score, accepted = plain_judge(model, text)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-5, i
        assert bool(accepted) == got[i].accepted or abs(score - language_id.LEAST_COSINE) < 1e-5, i


def test_languages_of_long_texts_are_learnt(as_docs):
    rnd = random.Random(3)
    latin = ["arma", "virumque", "cano", "troiae", "primus", "ab", "oris", "italiam", "fato", "profugus", "laviniaque", "venit"]
    english = ["the", "stone", "river", "bright", "walk", "under", "lamp", "north", "garden", "quiet", "paper", "with"]
    text = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(latin, 9000), "la") for i in range(9)] + [(100 + i, text(english, 60), "en") for i in range(60)]
    model = language_id.fit(as_docs(rows))
    out = language_id.identify(as_docs([(1, text(latin, 30)), (2, text(english, 30)), (3, text(latin, 12_000))]), model).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "la", 2: "en", 3: "la"}


def test_samples_are_bounded_in_rows(as_docs, monkeypatch):
    from loomspark.llm import common
    sizes = []
    whole = common.bounded_sample

    def counted(*args):
        out = whole(*args)
        sizes.append((args[1], out.groupBy(*args[1]).count().agg({"count": "max"}).first()[0]))
        return out
    monkeypatch.setattr(language_id, "bounded_sample", counted)
    rows = [(None, "the same null row", "en") for _ in range(5000)] + [(None, f"other words {i}", "de") for i in range(3)]
    model = language_id.fit(as_docs(rows).repartition(3))
    assert [k for k, _ in sizes] == [["lang"], ["lang", "size"]] and all(n == language_id.SAMPLE_ROWS for _, n in sizes)
    assert set(model["langs"]) == {"de", "en"}


def test_most_languages_that_are_learnt(as_docs, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(i, f"words of {lang}", lang) for lang, n in (("a", 30), ("b", 20), ("c", 3)) for i in range(n)]
    assert set(language_id.fit(as_docs(rows))["langs"]) == {"a", "b"}


def cosines(model, text):
    dims, counts, _ = language_id.counter()(text)
    return model["centres"] @ np.bincount(dims, language_id.weights(dims, counts, model["idf"]), 1 << language_id.DIMS_LOG2)


def test_every_training_text_is_learnt_from(as_docs, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 3)
    rnd = random.Random(9)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word("abcdefghij") for _ in range(20)), "x") for i in range(120)]
    rows += [(200 + i, " ".join(word("klmnopqrst") for _ in range(20)), "y") for i in range(120)]
    learnt = language_id.fit(as_docs(rows).repartition(5))
    held = language_id.identify(as_docs(rows), learnt).where("held_out").select("doc_id").collect()
    for i, text, lang in rows:  # every trigram of every training text has a weight in a centroid of its language
        dims, _, _ = language_id.counter()(text)
        own = np.array([x == lang for x in learnt["langs"]])
        assert (i,) in [tuple(r) for r in held] or (learnt["centres"][own][:, dims] > 0).any(axis=0).all(), i
    again = language_id.fit(as_docs(rows).repartition(2))
    assert learnt["langs"] == again["langs"] and learnt["floors"].keys() == again["floors"].keys()


def test_floors_count_every_training_text(as_docs, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 3)
    monkeypatch.setattr(language_id, "QUANTILE", 0.0)
    monkeypatch.setattr(language_id, "EXCERPT_CHARS", (100_000,))
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(ITALIAN + DUTCH + POLISH) for _ in range(rnd.randint(5, 40))), "x") for i in range(150)]
    model = language_id.fit(as_docs(rows))
    held = {r.doc_id for r in language_id.identify(as_docs(rows), model).where("held_out").collect()}
    least = {}
    for i, text, _ in rows:
        if i not in held:
            k = language_id.length_class(len(language_id.counter()(text)[0]))
            least.setdefault(k, []).append(float(cosines(model, text).max()))
    want = {k: language_id.REJECT_SHARE * min(v) for k, v in least.items() if len(v) >= language_id.LEAST_ROWS}
    got = {k: f for (near, k), f in model["floors"].items() if near is None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
