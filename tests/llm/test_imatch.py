import hashlib
import math
import random
import re

import xxhash
from pyspark.sql import functions as F

from loomspark.llm import imatch

SEED = 42


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def h_long(v, seed=SEED):
    return xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)


def h_int(v, seed):
    return xxhash.xxh64_intdigest(v.to_bytes(4, "little"), seed)


def h_array(values):
    seed = SEED
    for v in values:
        seed = h_long(v, seed)
    return seed


def plain_terms(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    return {signed(xxhash.xxh64_intdigest(w.encode(), SEED)) for w in words}


def in_subset(term, r, lev):
    per = 64 // imatch.BITS
    field = term if r < per else signed(h_int(r // per, h_long(term)))
    first = (field >> (imatch.BITS * (r % per))) & ((1 << imatch.BITS) - 1)
    return first < 1 << (imatch.BITS - lev)


def plain_fingerprint(text, lexicon):
    found = plain_terms(text)
    lev = min(imatch.BITS - 1, max(0, math.floor(math.log2(len(found) / imatch.TERMS)))) if found else 0
    kept = sorted(t for t in found & lexicon if any(in_subset(t, r, lev) for r in range(imatch.SUBSETS)))
    if not kept:
        whole = h_array(sorted(found)) if found else xxhash.xxh64_intdigest(text.encode(), SEED)
        return lev, None, f"all:{whole:x}"
    out = []
    for add in (0, 1):
        for r in range(imatch.SUBSETS):
            own = [t for t in kept if in_subset(t, r, lev + add)]
            out.append(f"{h_array(own):x}"[-8:] if own else "-")
    return lev, out, f"{lev}:" + ".".join(out)


def plain_likeness(a, b):
    if a[2] == b[2]:
        return 1.0
    if a[1] is None or b[1] is None or abs(a[0] - b[0]) > 1:
        return 0.0
    n = imatch.SUBSETS
    x, y = (a[1], b[1]) if a[0] == b[0] else (a[1][n:], b[1][:n]) if a[0] < b[0] else (a[1][:n], b[1][n:])
    either = sum(p != "-" or q != "-" for p, q in zip(x, y))
    return sum(p == q != "-" for p, q in zip(x, y)) / either if either else 0.0


def plain(rows):
    """Every field of compare_edits, one document after another."""
    rows = [(i, t or "") for i, t in rows]
    n = len(rows)
    df = {}
    for _, t in rows:
        for term in plain_terms(t):
            df[term] = df.get(term, 0) + 1
    low, high = (n * math.exp(-b) for b in reversed(imatch.BAND))
    lexicon = {t for t, c in df.items() if low <= c <= high}
    marks = [plain_fingerprint(t, lexicon) for _, t in rows]
    out = []
    for k, (i, t) in enumerate(rows):
        q, nxt = len(t) // 4, rows[(k + 1) % n][1]
        cut = t[:len(t) - q] + nxt[:q]
        mark = plain_fingerprint(cut, lexicon)
        out.append((i, len(t), hashlib.sha256(cut.encode()).hexdigest(), marks[k][2], mark[2],
                    round(plain_likeness(marks[k], mark), 9), round(plain_likeness(marks[k], marks[(k + 1) % n]), 9)))
    return out


def collected(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
             round(r.near_next, 9)) for r in df.orderBy(F.col("doc_id").asc_nulls_last()).collect()]


def corpus():
    rnd = random.Random(31)
    words = ["".join(rnd.choice("abcdefghijklmnopéß") for _ in range(rnd.randint(3, 8))) for _ in range(20_000)]
    text = lambda n: " ".join(words[int(20_000 * rnd.random() ** 4)] for _ in range(n))
    rows = [(i * 3, text(rnd.choice([2, 9, 40, 200, 900]))) for i in range(150)]
    rows[20] = (60, rows[19][1])
    rows[30:36] = [(90, None), (93, ""), (96, " \n"), (99, "?!"), (102, "the"), (105, "😀é " * 70)]
    return rows + [(1000, "long " + text(30_000))]


def test_equals_plain_version(as_docs):
    rows = corpus()
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    got = collected(imatch.compare_edits(as_docs(shuffled).repartition(5)))
    assert got == plain(rows)


def test_edits_keep_part_of_the_fingerprint(as_docs):
    rows = collected(imatch.compare_edits(as_docs(corpus())))
    long = [r for r in rows if r[1] > 200]
    assert sum(r[5] > r[6] for r in long) >= 0.9 * len(long)


def test_nulls_ties_and_repeated_rows(as_docs):
    text = "one two three four five six seven eight nine ten"
    out = imatch.compare_edits(as_docs([(7, text), (7, text), (7, text.upper()), (None, text), (3, None)])).collect()
    assert len(out) == 5
    assert len({r.fingerprint for r in out if r.n_chars}) == 1       # case does not count
    assert {r.next_id for r in out if r.doc_id is None} == {3}       # null ids come last, then the first again
    one = imatch.compare_edits(as_docs([(5, "alone here")])).collect()
    assert [(r.doc_id, r.next_id, r.near_next) for r in one] == [(5, 5, 1.0)]


def test_empty_table_and_missing_column(as_docs):
    assert imatch.compare_edits(as_docs([])).count() == 0


def test_no_python_workers(as_docs):
    plan = imatch.compare_edits(as_docs(corpus()[:20]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
