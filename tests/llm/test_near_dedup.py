import random

import numpy as np

from loomspark.llm import near_dedup as nd


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute_groups(texts):
    """Connected components over all pairs."""
    shingles = nd.shingler()
    seqs = [shingles(t or "") for t in texts]
    plain = ["".join((t or "").split()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            a, b = seqs[i], seqs[j]
            if not len(a) or not len(b):
                same = not len(a) and not len(b) and plain[i] == plain[j]
            else:
                same = nd.similar(a, b)
            if same:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def classes(keys):
    out = {}
    for i, k in enumerate(keys):
        out.setdefault(k, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_banded_distance_equals_full_table():
    rnd = random.Random(4)
    for _ in range(300):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 25))]
        b = a[:]
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randint(0, len(b))
            b[k:k + rnd.randint(0, 2)] = [rnd.randint(0, 5)] * rnd.randint(0, 2)
        want = edit_distance(a, b)
        for limit in (0, 2, 5, 30):
            got = nd.edit_distance_within(np.array(a, np.int64), np.array(b, np.int64), limit)
            assert got == (want if want <= limit else None)
            assert len(a) + len(b) == 0 or nd.most_common(np.array(a), np.array(b)) >= max(len(a), len(b)) - want


def test_similar_equals_full_table():
    rnd = random.Random(8)
    for _ in range(300):
        a = [rnd.randint(0, 40) for _ in range(rnd.randint(1, 60))]
        b = a[:]
        for _ in range(rnd.randint(0, 12)):
            k = rnd.randrange(len(b) + 1)
            b[k:k + rnd.randint(0, 2)] = [rnd.randint(0, 40) for _ in range(rnd.randint(0, 2))]
        if rnd.random() < 0.2:
            b = b[len(b) // 3:] + b[:len(b) // 3]
        n = max(len(a), len(b))
        assert nd.similar(np.array(a), np.array(b)) == (edit_distance(a, b) <= int(n * 0.2 + 1e-9))


def test_shingles_depend_on_words_only():
    s = nd.shingler()
    assert (s("The  quick, brown fox jumps over") == s("the quick brown\nFOX jumps... over")).all()
    assert len(s("a b")) == 1 and len(s("?!")) == 0 and len(s("a b c d e f")) == 2


def planted():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7)))
    texts = []
    passage = " ".join(word() for _ in range(60))
    for g in range(40):
        base = [word() for _ in range(rnd.choice([30, 120, 700]))]
        texts.append(" ".join(base))
        for _ in range(g % 4):
            copy = base[:]
            for _ in range(max(1, len(base) // 100)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(90):  # one bucket of many unlike texts around a shared passage
        texts.append(passage + " " + " ".join(word() for _ in range(30)))
    base = [word() for _ in range(150)]
    for _ in range(120):  # a large group
        copy = base[:]
        copy[rnd.randrange(150)] = word()
        texts.append(" ".join(copy))
    return texts + [texts[0], texts[0].upper() + "!", None, "", " \n", "?!", "? !", "same", "same", "x " * 30_000]


def test_groups_equal_brute_force(as_docs):
    texts = planted()
    rows = [(i, t) for i, t in enumerate(texts)]
    out = nd.near_dedup(as_docs(rows)).collect()
    got = {r.doc_id: r for r in out}
    want = classes(brute_groups(texts))
    assert classes([got[i].class_id for i in range(len(texts))]) == want
    assert sorted(r.doc_id for r in out if r.kept) == [c[0] for c in want]
    assert all(got[i].class_size == len(c) for c in want for i in c)


def test_short_texts_equal_brute_force(as_docs):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for n in [8, 9, 10, 14, 19, 24, 28, 29, 34] * 25:
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for copy in ([*base, word()], [word(), *base], [word(), *base[1:]], [*base[:-1], word()]):
            if rnd.random() < 0.5:
                texts.append(" ".join(copy))
    got = {r.doc_id: r.class_id for r in nd.near_dedup(as_docs(list(enumerate(texts)))).collect()}
    assert classes([got[i] for i in range(len(texts))]) == classes(brute_groups(texts))
    shared = " ".join(word() for _ in range(7))  # many unlike texts around common k-mers, and 8/9 and 9/9 words
    texts = [f"{shared} {word()} {word()} {word()}" for _ in range(60)]
    texts += ["a b c d e f g h", "a b c d e f g h i", "z a b c d e f g h", "q r s t u v w x y", "q r s t u v w x k"]
    got = {r.doc_id: r.class_id for r in nd.near_dedup(as_docs(list(enumerate(texts)))).collect()}
    assert got[60] == got[61] == got[62] == 60 and got[63] == got[64] == 63
    assert classes([got[i] for i in range(len(texts))]) == classes(brute_groups(texts))


def test_repeated_rows_and_null_ids(as_docs):
    text = "one two three four five six seven"
    out = nd.near_dedup(as_docs([(7, text), (7, text), (None, text), (None, "other words")])).collect()
    assert sum(r.kept for r in out) == 2
    assert {(r.class_id, r.class_size) for r in out} == {(7, 3), (None, 1)}


def test_empty_table(as_docs):
    assert nd.near_dedup(as_docs([])).count() == 0


def test_one_pair_per_text_and_round(as_docs, spark, monkeypatch, tmp_path):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base, passage = [word() for _ in range(80)], [word() for _ in range(60)]
    texts = []
    for _ in range(1600):  # one large group whose texts differ from one another in up to four words
        copy = base[:]
        for _ in range(2):
            copy[rnd.randrange(80)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(40)]) for _ in range(400)]  # one bucket, no group
    monkeypatch.setattr(nd, "work_dir", lambda s, name: f"{tmp_path}/{name}")
    got = {r.doc_id: r.class_id for r in nd.near_dedup(as_docs(list(enumerate(texts)))).collect()}
    assert sum(got[i] == got[0] for i in range(1600)) == 1600
    assert all(got[i] == i for i in range(1600, 2000))
    for r in range(nd.ROUNDS):
        path = tmp_path / "near-dedup" / f"pairs-{r}"
        if path.exists():
            pairs = spark.read.parquet(str(path))
            assert pairs.count() == pairs.select("a").distinct().count() <= 2000


def test_merged_equals_union_find(spark, tmp_path):
    rnd = random.Random(5)
    comp = spark.createDataFrame([], "rid long, comp long")
    links = []
    for r in range(3):
        new = [(a, b) for a, b in ((rnd.randrange(150), rnd.randrange(150)) for _ in range(30)) if a != b]
        links += new
        comp = nd._merged(comp, spark.createDataFrame(new, "a long, b long"), f"{tmp_path}/{r}")
        parent = {v: v for p in links for v in p}
        for _ in parent:
            for a, b in links:
                parent[a] = parent[b] = min(parent[a], parent[b])
        rows = comp.collect()
        assert len(rows) == len({x.rid for x in rows}) == len(parent)
        assert classes([x.comp for x in sorted(rows)]) == classes([parent[v] for v in sorted(parent)])
