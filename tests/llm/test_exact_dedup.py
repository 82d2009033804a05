import hashlib

from pyspark.sql import functions as F

from loomspark.llm.exact_dedup import exact_dedup

ROWS = [(1, "a b"), (2, "a  b\n"), (3, "ab"), (4, None), (5, ""), (6, " \t\x0b"), (7, "B"), (7, "B"),
        (None, "a b"), (8, "a b"), (9, "x" * 300_000), (10, "x " * 150_000 + "x" * 150_000), (11, "é😀"), (12, "é 😀")]


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        t = t or ""
        groups.setdefault(t.translate({c: None for c in (32, 9, 10, 11, 12, 13)}), []).append(
            (-len(t), d is None, d or 0, i, d))
    out = []
    for norm, g in groups.items():
        top = min(g)
        out += [(d, top[4], len(g), hashlib.sha256(norm.encode()).hexdigest()) for *_, d in g]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=repr)


def test_groups_and_keepers(as_docs):
    out = exact_dedup(as_docs(ROWS)).cache()
    assert rows_of(out) == brute(ROWS)
    groups = len({r[3] for r in brute(ROWS)})
    assert out.where("kept").count() == groups          # also among repeated rows
    assert out.where("kept and doc_id is distinct from keep_id").count() == 0


def test_weak_digest_is_split_by_full_bytes(as_docs):
    out = exact_dedup(as_docs(ROWS), digest=lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 0))
    assert rows_of(out) == brute(ROWS)


def test_state_spans_batches_and_deliveries(as_docs, tmp_path):
    state = f"file://{tmp_path}/state"
    first = exact_dedup(as_docs(ROWS[:5]).repartition(4), state_dir=state, batch_bytes=1)
    assert rows_of(first) == brute(ROWS[:5])
    again = exact_dedup(as_docs([(0, "ab"), (20, "new")]), state_dir=state)
    got = {r[0]: (r[1], r[2]) for r in rows_of(again)}
    assert got == {0: (2, 4), 20: (20, 1)}


def test_empty_table(as_docs):
    assert exact_dedup(as_docs([])).count() == 0


def test_weak_digest_across_deliveries(spark, tmp_path):
    weak = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 0)  # noqa: E731  every text has the same digest
    state = f"file://{tmp_path}/state"
    seen = []
    for k, rows in enumerate([[(1, "alpha"), (2, "al pha")], [(3, "beta"), (4, "alpha "), (5, "alpha x")], [(6, "be ta"), (7, "gamma")]]):
        path = str(tmp_path / f"delivery-{k}")
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
        docs = spark.read.parquet(path)
        seen += rows
        got = rows_of(exact_dedup(docs, state_dir=state, digest=weak))
        now = {i for i, _ in rows}
        assert got == [r for r in brute(seen) if r[0] in now]
