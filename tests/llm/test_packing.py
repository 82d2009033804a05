import random
from collections import defaultdict

from loomspark.llm import packing


def naive(items, capacity):
    """Best fit by trying every bin."""
    bins, out = [], {}
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        n, s, c = items[i]
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n
                and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        out[i] = (k, capacity - bins[k]["left"])
        bins[k]["left"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
    return [out[i] for i in range(len(items))]


def test_best_fit_equals_naive_search():
    rnd = random.Random(5)
    for _ in range(20):
        items = [(rnd.randint(1, 100), rnd.choice([None, "a", "b", "c"]), rnd.choice([None, *range(30)]))
                 for _ in range(120)]
        assert packing.best_fit(items, 100) == naive(items, 100)


def test_pieces_cover_texts_and_bins_hold(as_docs):
    rnd = random.Random(2)
    rows = [(i, "é" * rnd.randint(1, 260), None, f"s{i % 3}") for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", None, "s1"), (1002, "x" * 5000), (1003, "x" * 5000),
             (None, "copy", None, "h"), (None, "copy", None, "h"), (7, "y" * 100, None, "s1")]
    out = packing.pack(as_docs(rows), capacity=100, shard_rows=64).collect()
    by_doc, bins = defaultdict(int), defaultdict(list)
    for r in out:
        by_doc[r.doc_id] += r.length
        if r.length:
            bins[r.bin_id].append(r)
    want = defaultdict(int)
    for d, t, *_ in rows:
        want[d] += len(t or "")
    assert by_doc == want
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in rs:
            assert r.bin_offset == end
            end += r.length
        assert end <= 100
        src = [r.source for r in rs if r.source is not None]
        assert len(src) == len(set(src)) and len({r.cluster for r in rs}) == len(rs)


def test_clusters_are_those_of_the_dedup_operators(as_docs):
    rows = [(1, "abc", None, "s1"), (2, " abc", None, "s2"), (3, "a bc\n", None, "s3"), (4, "other", None, "s4"),
            (5, "others", None, "s5"), (6, "more", None, "s6")]
    bins = {r.doc_id: r.bin_id for r in packing.pack(as_docs(rows), capacity=100).collect()}
    assert len({bins[i] for i in (1, 2, 3)}) == 3
    docs = as_docs(rows).toDF("doc_id", "text", "class_id", "source", "n_chars", "digest", "other")
    classes = docs.selectExpr("doc_id", "text", "source", "case when doc_id in (4, 5, 6) then 4 end as class_id")
    out = packing.pack(classes, capacity=100, cluster_col="class_id").collect()
    bins = {r.doc_id: r.bin_id for r in out}
    assert len({bins[i] for i in (1, 2, 3)}) == len({bins[i] for i in (4, 5, 6)}) == 3


def test_empty_table(as_docs):
    assert packing.pack(as_docs([])).count() == 0
