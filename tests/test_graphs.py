"""Depths, cycles and revisits of task graphs against a plain search."""
import random

from loomspark.operators import graphs


def plain(edges, nodes):
    edges = {(s, d) for s, d in edges if s is not None and d is not None}
    nodes = set(nodes) | {x for e in edges for x in e}
    after = {n: {d for s, d in edges if s == n} for n in nodes}

    def reached(n):
        seen, todo = set(), list(after[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        return seen
    reach = {n: reached(n) for n in nodes}
    group = {n: {m for m in reach[n] if n in reach[m]} for n in nodes}
    cycle = {n: min(group[n]) if n in reach[n] else None for n in nodes}
    depth = {}
    for n in nodes:
        into = {s for s, d in edges if d == n}
        if not into or (cycle[n] is not None and not any(s not in group[n] for m in group[n] for s, d in edges if d == m)):
            depth[n] = 0
    level = list(depth)
    while level:
        level = {d for n in level for d in after[n] if d not in depth} and [
            depth.setdefault(d, depth[n] + 1) and d for n in level for d in sorted(after[n]) if d not in depth]
    return {n: (depth[n], cycle[n], max(0, len({s for s, d in edges if d == n}) - 1)) for n in nodes}


def structure(spark, edges, nodes=(), dag="g"):
    e = spark.createDataFrame([(dag, *x) for x in edges], "dag_id string, src string, dst string")
    n = spark.createDataFrame([(dag, x) for x in nodes], "dag_id string, task_id string")
    out = graphs.task_structure(e, n).collect()
    assert len(out) == len({(r["dag_id"], r["task_id"]) for r in out})
    return {r["task_id"]: (r["depth"], r["cycle_id"], r["revisits"]) for r in out}


def test_shapes_by_hand(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("e", "f"),      # a cycle behind a root
             ("p", "q"), ("q", "r"), ("r", "p"), ("s", "s"), ("s", "t"), ("t", "u"),      # a ring, a loop that starts
             ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("a", "w"), ("a", "w"), ("a", None)]
    got = structure(spark, edges, ["alone", "a"])
    assert got == {"a": (0, None, 0), "b": (1, "b", 1), "c": (2, "b", 0), "d": (3, "b", 0), "e": (4, None, 0), "f": (5, None, 0),
                   "p": (0, "p", 0), "q": (0, "p", 0), "r": (0, "p", 0), "s": (0, "s", 0), "t": (1, None, 0), "u": (2, None, 0),
                   "x": (0, "x", 0), "y": (0, "x", 0), "z": (0, "x", 0), "w": (1, None, 1), "alone": (0, None, 0)}


def test_nodes_between_cycles_lie_on_none(spark):
    edges = [("b", "c"), ("c", "b"), ("c", "a"), ("b", "a"), ("a", "d"), ("a", "e"), ("d", "e"), ("e", "d"), ("r", "b")]
    assert structure(spark, edges) == plain(edges, [])
    assert structure(spark, edges)["a"] == (2, None, 1)


def test_random_graphs_equal_plain_search(spark):
    rnd = random.Random(12)
    edges, nodes = [], [f"n{i:02d}" for i in range(60)]
    for k in range(0, 60, 15):  # four parts of different density in one graph
        part = nodes[k:k + 15]
        for _ in range((14, 18, 26, 9)[k // 15]):
            edges.append((rnd.choice(part), rnd.choice(part)))
    assert structure(spark, edges, nodes) == plain(edges, nodes)


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    calls = []
    cut = graphs.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: calls.append(1) or cut(df))
    chain = [(f"t{i:05d}", f"t{i + 1:05d}") for i in range(5000)]
    got = structure(spark, chain + [("t05000", "end"), ("start", "end")])
    assert got["t04999"] == (4999, None, 0) and got["end"] == (1, None, 1) and len(got) == 5003
    assert len(calls) < 2 * 14 + 20
    ring = [(f"r{i:03d}", f"r{(i + 1) % 300:03d}") for i in range(300)]
    assert set(structure(spark, ring).values()) == {(0, "r000", 0)}


def test_empty(spark):
    assert structure(spark, []) == {}


def test_rounds_are_planned_with_real_sizes(spark, monkeypatch):
    sizes = []
    cut = graphs.cut_lineage

    def seen(df):
        out = cut(df)
        sizes.append(int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return out
    monkeypatch.setattr(graphs, "cut_lineage", seen)
    edges = spark.createDataFrame([("g", f"t{i:03d}", f"t{i + 1:03d}") for i in range(300)], "dag_id string, src string, dst string")
    assert graphs.task_structure(edges, edges.selectExpr("dag_id", "src task_id").limit(0)).count() == 301
    assert max(sizes) < 1 << 30
