import numpy as np
import pandas as pd

from loomspark.llm import neighbours as nn


def brute(rows, k, every=20):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 4
            and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = []
    for i, v in sorted(good):
        if i % every == 0:
            near = sorted({(-float((np.array(v) * np.array(w)).sum()), j) for j, w in good if j != i})[:k]
            out += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    return out


def rows():
    rnd = np.random.default_rng(3)
    out = [(int(i), [float(np.float32(c)) for c in rnd.normal(size=4)]) for i in range(400)]
    same = out[20][1]
    out += [(1000 + i, same) for i in range(150)]              # copies, some of them queries
    out += [(2000, None), (2001, [0.0] * 4), (2002, [1.0, None, 0.0, 0.0]), (2020, [float("nan"), 1.0, 0.0, 0.0]),
            (2040, [float("inf"), 0.0, 0.0, 0.0]), (2060, [1.0]), (None, same), (40, out[40][1]), (2080, [])]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<float>, label int, VEC_ID string")


def test_full_windows_equal_brute_force(spark):
    out = nn.search(frame(spark, rows()), k=20, window_share=2.0, curves=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in out) == brute(rows(), 20)


def test_recall(spark):
    data = [r for r in rows() if r[0] is not None and r[0] < 2000]
    found = nn.search(frame(spark, data)).cache()
    assert nn.recall(found, frame(spark, data)) >= 0.9


def test_few_rows_and_none(spark):
    few = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.5, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 1.0])]
    out = nn.search(frame(spark, few)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
    assert nn.search(frame(spark, [])).count() == 0
    assert nn.search(frame(spark, few[:1])).count() == 0


def test_hilbert_curve_visits_neighbours():
    g = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = nn.hilbert_keys(g, 3)
    assert sorted(key) == list(range(512))
    path = g[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_ties_at_the_border_of_a_block_go_to_the_smaller_id():
    rnd = np.random.default_rng(3)
    b = rnd.integers(0, 2, (400, 16)).astype(float)
    cid = rnd.permutation(400)
    q = rnd.integers(0, 2, (30, 16)).astype(float)
    got = nn._best_of_block(6)(
        pd.DataFrame({"eid": range(1000, 1030), "vec": list(q)}),
        pd.DataFrame({"eid": range(400), "cid": cid, "vec": list(b)}))
    for i in range(30):
        want = np.lexsort((cid, -(b @ q[i])))[:6]
        assert got.eid[got.qid == 1000 + i].tolist() == want.tolist()


def clustered(n, dim=64, seed=5):
    """Vectors around n / 50 centres: twenty near neighbours of each are in its own cluster."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(n // 50, dim))
    x = centres[np.arange(n) % len(centres)] + rnd.normal(size=(n, dim)) * 0.15
    return [(int(i), [float(np.float32(c)) for c in v / np.linalg.norm(v)]) for i, v in enumerate(x)]


def test_fixed_windows_keep_work_and_recall(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(nn, "BLOCK_ROWS", 64)
    per_query = []
    for n in (2000, 6000):
        monkeypatch.setattr(nn, "work_dir", lambda s, name, n=n: f"{tmp_path}/{n}")
        data = frame(spark, clustered(n))
        found = nn.search(data, window_rows=200, curves=16).cache()
        assert nn.recall(found, data) >= 0.9
        blocks = spark.read.parquet(f"{tmp_path}/{n}/spots").groupBy("eid").count().agg({"count": "max"}).first()[0]
        per_query.append(blocks)
    assert max(per_query) <= 16 * (200 // 64 + 2)  # whatever the table


def test_recall_without_structure(spark):
    rnd = np.random.default_rng(9)
    data = frame(spark, [(i, [float(np.float32(c)) for c in rnd.normal(size=64)]) for i in range(5000)])
    assert nn.recall(nn.search(data).cache(), data) >= 0.9
