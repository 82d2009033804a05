"""Structure of task graphs with cycles (G3): depths, cycles and revisits, in few rounds.

1. *Chains.*  A node with one edge in and one out lies inside a chain.  Pointer doubling finds, for
   every such node, the ends of its chain and how far they are: a chain of n nodes takes log2(n) rounds.
   A ring of such nodes never ends; its smallest node names it.
2. *Strongly connected components* of what is left, with each chain as one edge: nodes without an
   edge in or out are trimmed, and every node learns the smallest node that reaches it and the smallest that
   it reaches, both in one spread.  Where they are the same the node lies on a cycle with it.  An edge between
   nodes that learned different ones lies on no cycle; without these edges the rest goes on in many
   parts at once.
3. *Depths.*  Edges carry the length of their chain.  Shortest depths start from nodes without an edge in
   and from cycles that no edge enters, and are spread along edges until none improves.

Nodes are numbered first, so that rounds move pairs of longs.  A spread takes ``HOPS`` edges between two
tables that are written as files, so plans stay small, sizes are real and a lost executor
recomputes one round.  Its joins are merge joins: no round sends a table to the driver.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored as cut_lineage

#: Edges that values go along between two written tables.
HOPS = 3


def _double(inner: DataFrame, rounds: int) -> DataFrame:
    """Rows (v, way, to, far, low) of chain nodes with their pointers in either way: the first node outside the chain,
    how far it is and the smallest node on the way; nodes of rings keep a pointer into their ring."""
    for _ in range(rounds):
        ahead = inner.select(F.col("v").alias("to"), "way", F.col("to").alias("next"), F.col("far").alias("more"), F.col("low").alias("below"))
        step = inner.join(ahead.hint("merge"), ["to", "way"], "left")
        inner = cut_lineage(step.select(
            "v", "way", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"),
            F.least("low", "below").alias("low"), F.col("next").isNotNull().alias("open")))
        if inner.where("open").isEmpty():
            break
        inner = inner.drop("open")
    return inner.select("v", "way", "to", "far", "low")


def _spread(state: DataFrame, edges: DataFrame, sent: dict[str, Column]) -> DataFrame:
    """``state`` (``v`` and the columns that ``sent`` names) when its values have gone along ``edges`` (``from``, ``to``)
    until none gets smaller: a node keeps the least of its own and of what ``sent`` makes of its neighbours'."""
    least = list(sent)
    nodes = state.select("v").unionByName(edges.select(F.col("to").alias("v"))).distinct()
    every = cut_lineage(edges.withColumn("own", F.lit(False)).unionByName(  # a node also hears itself
        nodes.select(F.col("v").alias("from"), F.col("v").alias("to"), F.lit(True).alias("own")), allowMissingColumns=True))
    state = state.select("v", *least, F.lit(True).alias("fresh"))
    while True:
        for _ in range(HOPS):
            heard = every.join(state.withColumnRenamed("v", "from").hint("merge"), "from")
            both = heard.groupBy(F.col("to").alias("v")).agg(
                *[F.min(F.when(F.col("own"), F.col(c)).when(F.col("fresh"), sent[c])).alias(c) for c in least],
                *[F.min(F.when(F.col("own"), F.col(c))).alias(f"old_{c}") for c in least])
            lower = [F.coalesce(F.col(c) < F.col(f"old_{c}"), F.col(c).isNotNull()) for c in least]
            # a node that has heard nothing yet is not in the table
            state = both.select("v", *least, reduce(lambda a, b: a | b, lower).alias("fresh")).where(
                reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in least]))
        state = cut_lineage(state)
        if state.where("fresh").isEmpty():
            return state.drop("fresh")


def _components(edges: DataFrame) -> DataFrame:
    """(v, comp) of the nodes of edges (s, d) that lie on a cycle of several nodes."""
    done, left = None, edges
    while True:
        for _ in range(2):  # most of what has no edge in or none out
            left = left.join(left.select(F.col("d").alias("s")).distinct().hint("merge"), "s", "left_semi").join(
                left.select(F.col("s").alias("d")).distinct().hint("merge"), "d", "left_semi").select("s", "d")
        left = cut_lineage(left)
        if left.isEmpty():
            return done if done is not None else left.select(F.col("s").alias("v"), F.col("d").alias("comp"))
        ways = left.select(F.col("s").alias("from"), F.col("d").alias("to"), F.lit(True).alias("along")).unionByName(
            left.select(F.col("d").alias("from"), F.col("s").alias("to"), F.lit(False).alias("along")))
        label = _spread(ways.select(F.col("from").alias("v"), F.col("from").alias("above"), F.col("from").alias("below")).distinct(), ways,
                        {"above": F.when(F.col("along"), F.col("above")), "below": F.when(~F.col("along"), F.col("below"))})
        same = label.where("above = below")
        many = same.groupBy(F.col("above").alias("comp")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = cut_lineage(same.select("v", F.col("above").alias("comp")).join(many.select("comp").hint("merge"), "comp").select("v", "comp"))
        done = found if done is None else done.unionByName(found)
        rest = label.where("above <> below")
        ls, ld = rest.toDF("s", "as", "bs"), rest.toDF("d", "ad", "bd")
        left = cut_lineage(left.join(ls.hint("merge"), "s").join(ld.hint("merge"), "d").where("as = ad and bs = bd").select("s", "d"))


def task_structure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``dag_id, task_id, depth, cycle_id, revisits`` of every node, from edges ``dag_id, src, dst`` and nodes
    ``dag_id, task_id`` (ends of edges that are not among them count as nodes).

    ``cycle_id`` is the smallest task of the cycle, or of the cycles that hang together, that the node lies on (also by
    an edge to itself), null without one.  ``depth`` is the least number of edges from a node without an edge in;
    a cycle that no edge enters has depth 0 at all its nodes, so every node has a depth.  ``revisits``: how
    often a walk along all edges meets the node again, its different edges in beyond the first.  Repeated edges
    count once, edges with a null end not at all; an empty table gives no rows."""
    named = edges.where("dag_id is not null and src is not null and dst is not null").select("dag_id", "src", "dst").distinct()
    ends = [named.select("dag_id", F.col(c).alias("task_id")) for c in ("src", "dst")]
    names = (nodes.where("dag_id is not null and task_id is not null").select("dag_id", "task_id")
             .unionByName(ends[0]).unionByName(ends[1]).distinct())
    names = cut_lineage(names.withColumn("v", F.monotonically_increasing_id()))
    number = lambda c, name: names.select("dag_id", F.col("task_id").alias(c), F.col("v").alias(name)).hint("merge")
    every = cut_lineage(named.join(number("src", "s"), ["dag_id", "src"]).join(number("dst", "d"), ["dag_id", "dst"]).select("s", "d"))
    known = names.select("v")
    loops = every.where("s = d").select(F.col("s").alias("v"))
    links = every.where("s <> d")
    out_, in_ = (links.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias(n), F.min(o).alias(m))
                 for c, o, n, m in (("s", "d", "outs", "to"), ("d", "s", "ins", "back")))
    all_ = cut_lineage(known.join(out_, "v", "left").join(in_, "v", "left").join(loops.withColumn("loop", F.lit(True)), "v", "left"))
    inner = cut_lineage(all_.where("ins = 1 and outs = 1 and loop is null").select("v", "to", "back"))
    rounds = max(1, math.ceil(math.log2(inner.count() + 1)) + 1)
    way = lambda c: inner.select("v", F.lit(c).alias("way"), F.col(c).alias("to"), F.lit(1).cast("long").alias("far"), F.col("v").alias("low"))
    both = _double(way("to").unionByName(way("back")), rounds)
    ahead, behind = (both.where(F.col("way") == c).drop("way") for c in ("to", "back"))
    ring = ahead.join(inner.select(F.col("v").alias("to")), "to", "left_semi").select("v", F.col("low").alias("comp"))
    ring = cut_lineage(ring)
    chain = cut_lineage(ahead.join(ring, "v", "left_anti").select("v", "to", "far").join(
        behind.select("v", F.col("to").alias("from"), F.col("far").alias("since")), "v"))

    # chains as edges between the other nodes
    first = chain.select(F.col("v").alias("d"), F.col("to").alias("end"), "far")
    short = (links.join(chain.select(F.col("v").alias("s")), "s", "left_anti").join(ring.select(F.col("v").alias("s")), "s", "left_anti")
             .join(first, "d", "left").select("s", F.coalesce("end", "d").alias("d"), (F.coalesce("far", F.lit(0)) + 1).alias("w")))
    short = cut_lineage(short.groupBy("s", "d").agg(F.min("w").alias("w")))
    comp = _components(short.where("s <> d").select("s", "d"))
    alone = short.where("s = d").select(F.col("s").alias("v")).unionByName(loops).distinct().join(comp, "v", "left_anti")
    comp = cut_lineage(comp.unionByName(alone.withColumn("comp", F.col("v"))))
    of = lambda c, name: comp.select(F.col("v").alias(c), F.col("comp").alias(name))
    within = (chain.join(of("from", "c0"), "from").join(of("to", "c1"), "to").where("c0 = c1")
              .select("v", F.col("c0").alias("comp")))
    on_cycle = cut_lineage(comp.unionByName(within).unionByName(ring))
    least = on_cycle.join(names, "v").groupBy("comp").agg(F.min("task_id").alias("cycle_id"))
    cycles = cut_lineage(on_cycle.join(least, "comp").select("v", "comp", "cycle_id"))

    # cycles that no edge enters, and nodes without an edge in
    side = lambda c, name: on_cycle.select(F.col("v").alias(c), F.col("comp").alias(name))
    entered = (links.join(side("d", "cd"), "d").join(side("s", "cs"), "s", "left")
               .where("cs is null or cs <> cd").select(F.col("cd").alias("comp")).distinct())
    source = cut_lineage(on_cycle.join(entered, "comp", "left_anti").select("v"))
    best = cut_lineage(all_.where("ins is null and loop is null").select("v").unionByName(source).distinct()
                       .withColumn("depth", F.lit(0).cast("long")))
    best = _spread(best, short.select(F.col("s").alias("from"), F.col("d").alias("to"), "w"), {"depth": F.col("depth") + F.col("w")})
    along = (chain.join(best.withColumnRenamed("v", "from"), "from").select("v", (F.col("depth") + F.col("since")).alias("depth"))
             .join(source, "v", "left_anti"))
    depth = best.unionByName(along).groupBy("v").agg(F.min("depth").alias("depth"))
    ins = F.coalesce("ins", F.lit(0)) + F.when(F.col("loop"), 1).otherwise(0)
    return (all_.join(depth, "v", "left").join(cycles.select("v", "cycle_id"), "v", "left")
            .join(names, "v").select("dag_id", "task_id", "depth", "cycle_id", F.greatest(ins - 1, F.lit(0)).cast("long").alias("revisits")))
