from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from loomspark.llm import language_id, secrets
from loomspark.llm.common import work_dir, written

from .test_near_dedup import brute_groups, classes


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents and the result of every stage, with rows that need each stage's edge cases."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9000, None, None, None, 0), (9001, "", "en", "s", 0), (9002, "123", "en", "s", 3),
             (9003, "the and that of token = '98765432109876'", "en", None, 40), (9003, "the and that of token = '98765432109876'", "en", None, 40),
             (None, "the and that of the in", None, "s", None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [written(docs, work_dir(spark, "fixture"))]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf), work_dir(spark, name)))
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_schema_is_kept(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secrets", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_language_stage(stages):
    docs = stages[0]
    said = language_id.identify(docs, language_id.fit(docs), keep=("source", "n_chars", "lang"))
    assert stages[1].count() == said.where("accepted").count() == docs.count() - 3
    assert not rows(stages[1]) - rows(docs)


def test_exact_stage(stages):
    best = {}
    for r in stages[1].collect():
        norm = (r.text or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        key = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best[norm] = min(best.get(norm, (key, r)), (key, r), key=lambda x: x[0])
    assert rows(stages[2]) == Counter(tuple(r) for _, r in best.values())


def test_near_stage(stages):
    docs = sorted(stages[2].collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    firsts = [c[0] for c in classes(brute_groups([r.text for r in docs]))]
    assert rows(stages[3]) == Counter(tuple(docs[i]) for i in firsts)


def test_secret_stage(stages):
    scan = secrets.scanner()
    want = Counter()
    for r in stages[3].collect():
        text = r.text
        spans = sorted((s, e) for _, s, e, _ in scan(text))
        for s, e in reversed([x for i, x in enumerate(spans) if not i or x[0] >= max(e for _, e in spans[:i])]):
            inner = [y for y in spans if s <= y[0] < e]
            text = text[:s] + "[secret]" + text[max(y[1] for y in inner):]
        want[r.doc_id, text, r.lang, r.source, r.n_chars if len(text) == len(r.text) else len(text)] += 1
    assert rows(stages[4]) == want
    assert any("[secret]" in (t[1] or "") for t in want)


def test_packing_stage(stages):
    length = defaultdict(int)
    bins = defaultdict(list)
    for r in stages[5].collect():
        length[r.doc_id] += r.length
        if r.length:
            bins[r.bin_id].append(r)
    assert length == {r.doc_id: len(r.text or "") for r in stages[4].collect()}
    for rs in bins.values():
        assert sum(r.length for r in rs) <= 8192
        named = [r.source for r in rs if r.source is not None]
        assert len(named) == len(set(named))


def test_run_and_empty_table(spark, sf, stages):
    assert corpus_pipeline.ORACLE_SQL is None
    empty = written(stages[0].limit(0), work_dir(spark, "none"))
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, sf), work_dir(spark, name))
        assert empty.count() == 0


def test_run_over_a_folder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 0.8 * docs.count()
