import hashlib
import re

from loomspark.llm import pii

ROWS = [
    (1, "mail é😀 to.01@mail8.example.com, x@y and 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255"),
    (2, "card 4539 1488 0343 6467 or 4539148803436468 tel +1 (555) 010-9999. +12 +1234567 8"),
    (3, None), (4, ""), (4, ""), (5, "9" * 300_000), (6, "a" * 300_000 + "@"), (7, "1." * 100_000),
    (8, "a@b.c" + ".d" * 50_000), (9, "+1 " + " " * 200_000), (10, "a@b.cx_y@d.e a@b.c@d.e"),
    (None, "call (212) 555-0187 or write jane.doe (at) example (dot) org"), (11, "3782 822463 10005 card"),
    (12, "1 " * 3000 + "x@y.com"), (13, "0" * 16 + "-" + "4" * 3), (14, "AB12@Q-9.Z-z..com 1.1.1.1@x.y"),
]


def brute(t):
    t = t or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) if len(t) < 200_000 or "@" in t[:10] else ():
        out.append((0, m.start(), f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if len(t) < 250_000 else ():
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(g) <= 19 and sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
                                      for i, v in enumerate(reversed(g))) % 10 == 0:
            out.append((2, m.start(), f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), f"phone:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_against_brute_force(as_docs):
    got = sorted((repr(r.doc_id), r.base_sha256) for r in pii.summary(pii.find_personal_data(as_docs(ROWS))).collect())
    assert got == sorted((repr(i), hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in ROWS)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pii.summary(pii.find_personal_data(docs)).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(out) == docs.count()
    for r in out:
        want = brute(r.text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) == len([x for x in want.split(",") if x])


def test_candidates_with_support_are_added(as_docs):
    rows = [(i, f"Please call (212) 555-01{i:02d} today or phone +1 (212) 555-01{i:02d} now") for i in range(40)]
    rows += [(100 + i, f"order 212 555-01{i:02d}x and no{i} 112.555-01{i:02d}/7") for i in range(20)]
    got = {r.doc_id: r for r in pii.summary(pii.find_personal_data(as_docs(rows))).collect()}
    assert all(got[i].n_phone == 1 and got[i].n_added == 1 for i in range(40))
    assert sum(got[100 + i].n_added for i in range(20)) == 0


def test_expectation_maximisation_finds_the_poor_labeler():
    # labeler 2 votes at random, 0 and 1 agree
    patterns = [((1, 1, 1), 45.0), ((1, 1, -1), 45.0), ((-1, -1, 1), 50.0), ((-1, -1, -1), 50.0)]
    post, table = pii.reliabilities(patterns)
    assert post[1, 1, -1] > 0.95 and post[-1, -1, 1] < 0.05
    assert table[0, 1][0] > 0.9 > 0.6 > table[2, 1][0]


def test_no_python_in_the_plan_and_empty_table(as_docs):
    assert pii.summary(pii.find_personal_data(as_docs([]))).count() == 0
    out = pii.summary(pii.find_personal_data(as_docs([(1, "nothing here")])))
    assert [(r.spans, r.n_added) for r in out.collect()] == [("", 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
