import random

import numpy as np
import pytest

from loomspark.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, VEC_ID string, score int"


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain(rows, every=100, positives=5, negatives=5):
    """All pairs, one after another."""
    ok = {(i, lab, tuple(v)) for i, v, lab in rows if None not in (i, lab, v) and v and None not in v
          and all(np.isfinite(np.float32(c)) for c in v)}
    lengths = [len(v) for _, _, v in ok]
    dim = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    ints = sorted({(i, lab, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, lab, v in ok if len(v) == dim})
    out = []
    for a in ints:
        if a[0] % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a[2], y[2])), y[0], y[1], y) for y in ints if y is not a))
        for s, pid, lab, _ in [x for x in scored if x[2] == a[1]][:positives]:
            near = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a[0], pid, r, x[1], -s, -x[0]) for r, x in enumerate(near, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
                  for r in hn.mine(df, **kw).collect())


def vectors(n, dim, seed, centres=6):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centres, dim))
    x = c[rnd.integers(0, centres, n)] + rnd.normal(size=(n, dim)) * 0.6
    return [[float(np.float32(v)) for v in r] for r in x]


def test_equals_all_pairs(table, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 60)
    monkeypatch.setattr(hn, "PART_ROWS", 8)
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 50)
    rnd = random.Random(6)
    rows = [(i, v, 0 if rnd.random() < 0.4 else rnd.randint(1, 6)) for i, v in enumerate(vectors(500, 20, 1))]
    rows += [(1000, rows[7][1], 3), (1001, rows[7][1], 4), (1100, rows[9][1], 99)]  # copies; a label of one row
    want = plain(rows, every=20)
    assert want and mined(table(rows), every=20) == want


def test_ties_and_few_values(table):
    rnd = random.Random(8)
    rows = [(i, [float(rnd.randint(-1, 1)) for _ in range(6)], rnd.randint(0, 2)) for i in range(300)]
    want = plain(rows, every=10)
    assert want and mined(table(rows), every=10) == want


def test_rows_that_take_no_part(table):
    good = [(i, v, i % 2) for i, v in enumerate(vectors(60, 8, 3))]
    bad = [(200, None, 1), (300, [], 1), (400, [1.0, None] * 4, 1), (500, [float("nan")] * 8, 0), (None, [1.0] * 8, 0),
           (600, [float("inf")] * 8, 0), (700, [1.0] * 8, None), (800, [1.0] * 5, 1), (0, *good[0][1:])]
    rows = good + bad
    assert mined(table(rows), every=10) == plain(rows, every=10) == plain(good, every=10)


def test_negative_positives_and_lone_labels_have_no_result(table):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.5, 0.5], 2), (100, [1.0, 1.0], 7)]
    assert mined(table(rows)) == []


def test_empty_table(table):
    out = hn.mine(table([]))
    assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                                "negative_score"]


def test_scores_beyond_exact_numbers_are_refused(table):
    with pytest.raises(ValueError):
        hn.mine(table([(0, [1e9, 1.0], 1), (1, [1.0, 1.0], 1)]))


def test_indexed_search_equals_full_product():
    rnd = np.random.default_rng(4)
    for width in (1, 3, 8):
        for _ in range(20):
            a, y = rnd.integers(-40, 40, (12, 17)).astype(float), rnd.integers(-40, 40, (90, 17)).astype(float)
            y[:30, 6:] = rnd.integers(-1, 2, (30, 11))  # rows that few lists need
            full = a @ y.T
            least = np.quantile(full, rnd.choice([0.2, 0.9, 0.99, 0.999]), axis=1) + rnd.integers(-5, 5, 12)
            i, j, s = hn.survivors(a, y, least, width)
            assert set(zip(i, j)) == set(zip(*np.nonzero(full >= least[:, None])))
            assert (s == full[i, j]).all()
