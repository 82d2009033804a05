import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import spelling
from loomspark.llm.queries import op12_spelling


def edits_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(counts):
    """All pairs of words."""
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and edits_one(v, w)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= 2 * counts[w] else None for w, b in best.items()}
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def some_words(seed, n=500, letters="abcdeé", sizes=(1, 2, 3, 5, 6, 9)):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.choice(sizes))) for _ in range(n)}
    for w in sorted(words)[::4]:
        k = rnd.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1:]}
    words = sorted(w for w in words if w)
    return {w: int(1 + 2 ** rnd.uniform(0, 10)) for w in words} | {"a" * 300: 4, "a" * 299 + "b": 9, "z" * 5: 1}


def test_equals_all_pairs(spark):
    counts = some_words(3)
    df = spark.createDataFrame([*counts.items()], "word string, n long")
    assert rows_of(spelling.variants(df)) == plain(counts)


def test_equals_all_pairs_over_many_split_cells(spark, monkeypatch):
    for name, value in (("SAMPLE_WORDS", 200), ("SAMPLE_LEAF", 4), ("CELL_WORDS", 16), ("ASKED_WORDS", 40), ("LEAF_WORDS", 4)):
        monkeypatch.setattr(spelling, name, value)
    counts = some_words(4, 700, "abc", (3, 4, 5, 6, 7))
    df = spark.createDataFrame([*counts.items()], "word string, n long").repartition(4)
    assert rows_of(spelling.variants(df)) == plain(counts)


def test_ties_chains_repeats_and_nulls(spark):
    rows = [("aaaab", 10), ("aaaac", 10), ("aaaa", 5), ("aaaacc", 100), ("aaaaccc", 1000), ("lonely", 7), (None, 3), ("nulls", None),
            ("twice", 3), ("twice", 4), ("twicx", 20)]
    got = {r[0]: r[1:] for r in rows_of(spelling.variants(spark.createDataFrame(rows, "word string, n long")))}
    assert got["aaaa"] == ("aaaab", "aaaab", 5, 2, 10)              # of equal counts the smaller word
    assert got["aaaac"] == ("aaaacc", "aaaaccc", 10, 3, 100)        # the root lies two forms on
    assert got["aaaab"][0] is None and got["lonely"] == (None, "lonely", 7, 0, None)
    assert got["twice"] == ("twicx", "twicx", 7, 1, 20) and len(got) == 8


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), times=1)


def plain_words(rows):
    c = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def test_query_equals_plain_version(spark, tmp_path):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefgÉéß×") for _ in range(rnd.randint(3, 8))) for _ in range(120)]
    rows = [(i, " ".join(rnd.choice(vocab) + rnd.choice([",", " ", "1", "ŝ", "-"]) for _ in range(60))) for i in range(200)]
    rows += [(None, rows[0][1]), (500, None), (501, ""), (7, rows[7][1]), (502, "ABCDEFG " * 5000 + "Ñandú x" * 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(op12_spelling(spark, str(tmp_path)))
    want = plain(plain_words(rows))
    assert got == want and any(r[1] for r in want)


def test_pairs_in_a_cell_equal_all_pairs():
    rnd = random.Random(9)
    words = lambda size, n: sorted({"".join(rnd.choice("abcé") for _ in range(size)) for _ in range(n)})
    for base, asked in ((words(6, 400), words(6, 300)), (words(7, 400), words(6, 300)), (words(5, 2), words(5, 3))):
        i, j = spelling.near_pairs(asked, base, spelling.deal(base))
        want = {(a, b) for a in asked for b in base if edits_one(a, b) and (len(a) < len(b) or a < b)}
        assert {(asked[x], base[y]) for x, y in zip(i, j)} == want and len(i) == len(want)


def test_one_edit_shifts_counts_by_at_most_one_each_way():
    rnd = random.Random(2)
    for _ in range(200):
        a = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(2, 9)))
        k = rnd.randrange(len(a))
        b = rnd.choice([a[:k] + "x" + a[k:], a[:k] + "d" + a[k + 1:]])
        v = spelling.vectors([a, b], spelling.deal([a]))
        d = v[1] - v[0]
        assert np.maximum(d, 0).sum() <= 1 and np.maximum(-d, 0).sum() <= int(len(a) == len(b))


def test_runs_are_maximal_and_lowered(as_docs):
    rows = as_docs([(1, "HeLLo, wÖrlds abcd ÀÉIOUs9xyzzy")])
    got = [r.run for r in spelling.runs(rows, "doc_id", "text", 5).orderBy(F.col("run")).collect()]
    assert got == sorted(["hello", "wÖrlds", "ÀÉious", "xyzzy"])
