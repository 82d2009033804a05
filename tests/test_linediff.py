"""Line changes against hand-written and longest-common-subsequence diffs."""
import random

import numpy as np

from loomspark.operators import linediff as L


def changes(spark, pairs):
    side = lambda k: L.lines_of(spark.createDataFrame([(n, p[k]) for n, p in pairs.items()], "path string, content string"), "path")
    out = {}
    files = spark.createDataFrame([(n,) for n, p in pairs.items() if None not in p], "path string")
    for r in L.line_changes(side(0), side(1), "path", files).collect():
        out.setdefault(r["path"], []).append((r["op"], r["no"], r["line"]))
    return {k: sorted(v) for k, v in out.items()}


def test_by_hand(spark):
    got = changes(spark, {
        "same": ("a\nb\n", "a\nb\n"), "end": ("a\nb", "a\nb\n"), "last": ("a\nb", "a\nb drift"),
        "more": ("x\n", "x\ny\n\nz\n"), "less": ("x\ny\nx\ny", "x\ny"), "none": ("", "p\nq"),
        "moved": ("one\ntwo\nthree\nfour\nfive", "four\none\ntwo\nthree\nfive"), "ends": ("a\r\nb\rc", "a\nb\nd"),
        "blank": ("\n\nk\n\n", "\nk\n\n\n"), "gone": ("a", None)})
    assert got == {"last": [("+", 2, "b drift"), ("-", 2, "b")], "more": [("+", 2, "y"), ("+", 3, ""), ("+", 4, "z")],
                   "less": [("-", 3, "x"), ("-", 4, "y")], "none": [("+", 1, "p"), ("+", 2, "q")],
                   "moved": [("+", 1, "four"), ("-", 4, "four")], "ends": [("+", 3, "d"), ("-", 3, "c")],
                   "blank": [("+", 4, ""), ("-", 2, "")]}


def rebuilt(old, got):
    gone = {n for op, n, _ in got if op == "-"}
    kept = iter([x for n, x in enumerate(old, 1) if n not in gone])
    new = {n: x for op, n, x in got if op == "+"}
    total = len(old) - len(gone) + len(new)
    return [new[n] if n in new else next(kept) for n in range(1, total + 1)]


def test_random_edits_give_the_new_file(spark):
    rnd = random.Random(7)
    pairs = {}
    for k in range(25):
        old = [rnd.choice(["", "end", "x = 1"]) if rnd.random() < 0.3 else f"line {rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 200))]
        new = old[:]
        for _ in range(rnd.randint(0, 12)):
            i = rnd.randint(0, len(new))
            new[i:i + rnd.randint(0, 3)] = [f"new {rnd.random()}"] * rnd.randint(0, 2)
        if k % 5 == 0 and new:
            new = new[len(new) // 2:] + new[:len(new) // 2]
        pairs[f"f{k}"] = ("\n".join(old) + "\n" if old else "", "\n".join(new) + "\n" if new else "")
    got = changes(spark, pairs)
    for name, (old, new) in pairs.items():
        assert rebuilt(old.splitlines(), got.get(name, [])) == new.splitlines(), name


def test_long_files_meet_in_rows_only(spark):
    n = 200_000
    old = spark.range(n).selectExpr("'big' AS path", "id + 1 AS no", "concat('line ', id) AS line")
    new = spark.range(n).where("id <> 77").selectExpr("'big' AS path", "CASE WHEN id > 77 THEN id ELSE id + 1 END AS no",
                                                      "CASE WHEN id = 150000 THEN 'edited' ELSE concat('line ', id) END AS line")
    rows = L.line_changes(old, new, "path")
    assert sorted(map(tuple, rows.collect())) == [("big", "+", 150_000, "edited"), ("big", "-", 78, "line 77"), ("big", "-", 150_001, "line 150000")]
    assert L.change_counts(rows, "path").first()[1:] == (2, 1)


def test_chain_and_gap(monkeypatch):
    assert L.heaviest_chain([5, 1, 2, 9], [3, 1, 1, 1]) == [0, 3]
    assert L.heaviest_chain([5, 1, 2, 9], [1, 1, 1, 1]) == [1, 2, 3] and L.heaviest_chain([], []) == []
    assert L.changed([1, 2, 3, 4], [1, 3, 2, 4]) in (([1], [2]), ([2], [1]))
    monkeypatch.setattr(L, "GAP_CELLS", 3)
    assert L.changed([1, 2, 3, 4], [1, 3, 2, 4]) == ([1, 2], [1, 2])


def test_empty(spark):
    assert changes(spark, {"a": (None, None)}) == {}
    none = spark.createDataFrame([], "path string, no long, line string")
    assert L.line_changes(none, none, "path").count() == 0


def test_many_files_take_few_python_calls(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    plain, chain = L._gap_changes, L._chosen

    def gaps(bucket):
        calls.add(1)
        return plain(bucket)

    def pair(old, new):
        calls.add(1)
        return plain(old, new)

    def chosen(group):
        calls.add(1)
        return chain(group)
    monkeypatch.setattr(L, "_gap_changes", gaps if plain.__code__.co_argcount == 1 else pair)
    monkeypatch.setattr(L, "_chosen", chosen)
    pairs = {f"f{i}": ("a\nb", "a\nc") for i in range(100)} | {f"g{i}": ("x\nx\ny", "x\ny\nx") for i in range(100)}
    got = changes(spark, pairs)
    assert all(got[f"f{i}"] == [("+", 2, "c"), ("-", 2, "b")] for i in range(100))
    assert all(rebuilt(["x", "x", "y"], got[f"g{i}"]) == ["x", "y", "x"] and len(got[f"g{i}"]) == 2 for i in range(100))
    assert calls.value <= 2


def test_gaps_of_any_size_keep_their_common_lines(spark):
    pairs = {}
    for name, n in (("short", 30), ("long", 3000)):
        old = [f"line {i % (n // 2)}" for i in range(n)]
        new = [*old[:9], "edited", *old[10:n - 9], "another", *old[n - 8:]]
        pairs[name] = ("\n".join(old), "\n".join(new))
    got = changes(spark, pairs)
    assert got == {name: [("+", 10, "edited"), ("+", n - 8, "another"), ("-", 10, "line 9"), ("-", n - 8, f"line {n // 2 - 9}")]
                   for name, n in (("short", 30), ("long", 3000))}


def test_places_are_those_of_the_whole_table(monkeypatch):
    monkeypatch.setattr(L, "GAP_CELLS", 10 ** 9)
    rnd = random.Random(3)

    def equal(a, b):
        return tuple(x.tolist() for x in L.changed_places(np.array(a, np.int64), np.array(b, np.int64))) == L.changed(a, b)
    long = [rnd.randrange(9) for _ in range(2500)]
    assert equal(long, [rnd.randrange(9) for _ in range(2600)]) and equal(long, long[:40] + long[47:2400] + [50, 51] + long[2400:])
    for _ in range(1500):
        monkeypatch.setattr(L, "BLOCK_ROWS", rnd.choice([1, 2, 5, 256]))
        monkeypatch.setattr(L, "PARTS", rnd.choice([2, 3, 64]))
        monkeypatch.setattr(L, "BAND", rnd.choice([1, 3, 256]))
        k = rnd.choice([1, 2, 4, 20])
        a = [rnd.randrange(k) for _ in range(rnd.randint(0, 40))]
        b = a[:]
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randint(0, len(b))
            b[i:i + rnd.randint(0, 4)] = [rnd.randrange(k + 3) for _ in range(rnd.randint(0, 4))]
        assert equal(a, b) and equal(b, a) and equal(a, a[::-1]), (a, b)
