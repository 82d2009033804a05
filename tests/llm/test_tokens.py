import random

import pytest

from loomspark.llm import tokens


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load_vocabulary()


def brute(seg, word):
    """Viterbi of one word on its own over all substrings."""
    best = [(0.0, [])]
    for i in range(1, len(word) + 1):
        found = []
        for j in range(i):
            hit = (seg.head if j == 0 else seg.body).get(word[j:i])
            if hit:
                found.append((best[j][0] + hit[0], i - j, best[j][1] + [hit[1]]))
        if not found:
            raw = word[i - 1].encode()
            found.append((best[i - 1][0] + seg.byte_score * len(raw), 1, best[i - 1][1] + [seg.byte[b] for b in raw]))
        best.append(max(found, key=lambda f: (f[0], f[1]))[::2])
    return best[-1][1]


TEXTS = ["The quick brown fox", "the  quick\nbrown\tfox ", " ", "", "naïve façade 😀 ▁mark ▁", "aaaa" * 50,
         "international internationally internation inter in i", "x" * 20_000]


def test_equals_word_by_word_viterbi(vocabulary, sf, spark):
    seg = tokens.Segmenter(vocabulary)
    more = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    random.Random(1).shuffle(more)
    for t, raw in zip(TEXTS[:-1] + more, seg.encode_batch(TEXTS[:-1] + more)):
        want = [i for w in t.split(" ") for i in brute(seg, tokens.MARK + w)] if t else []
        assert list(memoryview(raw).cast("i")) == want


def test_round_trip(vocabulary, as_docs):
    docs = as_docs([(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "a b"), (1, TEXTS[1])])
    back = tokens.decode(tokens.encode(docs, vocabulary), vocabulary).collect()
    want = [(i, t) for i, t in enumerate(TEXTS)] + [(50, ""), (None, "a b"), (1, TEXTS[1])]
    assert sorted(map(tuple, back), key=repr) == sorted(want, key=repr)
    out = tokens.digest(docs, vocabulary).collect()
    assert len(out) == len(want) and all(r.restored for r in out)
    assert {r.n_tokens for r in out if r.n_chars == 0} == {0}


def test_empty_table(vocabulary, as_docs):
    assert tokens.digest(as_docs([]), vocabulary).count() == 0


def test_vocabulary_must_be_complete():
    with pytest.raises(ValueError):
        tokens.Segmenter([("a", 0.0, 0)])


def test_decoding_takes_no_step_per_token():
    seg = tokens.Segmenter(tokens.load_vocabulary())
    text = "a line\nanother ☃ line\n\n end "
    raw, = seg.encode_batch([text])
    seg.pieces = None  # pieces are not looked at one by one, also where there are byte pieces
    assert seg.decode(raw) == text
