"""Cycles and components in a number of rounds that grows with the logarithm of path lengths.

Chains, nodes with one edge in and one out, are passed by pointer jumping: each round every node takes
over where its successor points, so distances double.  What is left after chains are contracted and
loose ends trimmed is searched by spreading names (graph.spread), whose rounds follow the width of that
core and not the length of chains.  Chains of a graph have no node in common, so no pointer is a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.tables import stored

WORTH = 0.8  # edges are trimmed, and chains contracted, anew while that leaves no more than so many of them


def jumped(pointers: DataFrame) -> tuple[DataFrame, int]:
    """(node, to, ends): pointers (node, to) followed to a node that has none, and how many rounds that took.

    ends is false on cycles, which never come to one; to means nothing there.
    """
    own = pointers.select("node").withColumn("more", F.lit(True))
    now = stored(pointers.join(own.withColumnRenamed("node", "to"), "to", "left").select("node", "to", F.coalesce("more", F.lit(False)).alias("more")), "pointers")
    rounds, left = 0, now.filter("more").count()
    while left:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("more").alias("still"))
        open_ = now.filter("more").join(ahead, "to").select("node", F.col("beyond").alias("to"), F.col("still").alias("more"))
        now = stored(now.filter(~F.col("more")).unionByName(open_), "pointers")
        rounds, before, left = rounds + 1, left, now.filter("more").count()
        if left == before:  # every chain comes nearer its end in each round: what doesn't is a cycle
            break
    return now.select("node", "to", (~F.col("more")).alias("ends")), rounds


def trimmed(e: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out, one layer of others taken off."""
    both = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node")
    return stored(e.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"), "trimmed")


def contracted(e: DataFrame) -> tuple[DataFrame, ...]:
    """Edges without chains; (node, head, tail) of chain nodes; and (node, scc) of cycles that are nothing but a chain.  Without a chain, the edges only.

    A chain from head to tail, neither of which is in a chain, becomes one edge.
    """
    into, out = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.min("src").alias("before")), e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.min("dst").alias("behind"))
    chain = stored(into.join(out, "node").filter("i = 1 AND o = 1").select("node", "before", "behind"), "chain")
    if chain.isEmpty():
        return (e,)
    tails, _ = jumped(chain.select("node", F.col("behind").alias("to")))
    heads, _ = jumped(chain.select("node", F.col("before").alias("to")))
    # names on a ring: the least node, found by jumping with minima
    ring = chain.join(tails.filter(~F.col("ends")).select("node"), "node", "left_semi")
    tied = stored(tails.filter("ends").select("node", F.col("to").alias("tail")).join(heads.select("node", F.col("to").alias("head")), "node"), "chains")
    names = chain.select("node")
    direct = e.join(names.withColumnRenamed("node", "src"), "src", "left_anti").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti")
    short = stored(direct.select("src", "dst").unionByName(tied.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct(), "contracted")
    return short, tied, least_on_rings(ring)


def least_on_rings(ring: DataFrame) -> DataFrame:
    """(node, scc): for nodes of rings (node, behind) the least node of their ring, in rounds that double what each has seen."""
    now = stored(ring.select("node", F.col("behind").alias("to"), F.least("node", "behind").alias("scc")), "rings")
    while True:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("scc").alias("theirs"))
        new = stored(now.join(ahead, "to").select("node", F.col("beyond").alias("to"), F.least("scc", "theirs").alias("scc"), (F.col("theirs") < F.col("scc")).alias("changed")), "rings")
        now = new.select("node", "to", "scc")
        if not new.filter("changed").limit(1).count():
            return now.select("node", "scc")


def strong(e: DataFrame) -> DataFrame:
    """(node, scc): nodes on a cycle of directed edges (src, dst), with the name of those that share cycles with them."""
    live = stored(e.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "live")
    chains, rings, left = [], None, live.count()
    while left:
        before = left
        while True:
            live = trimmed(live)
            was, left = left, live.count()
            if left > WORTH * was or not left:
                break
        live, *more = contracted(live)
        if more:
            chains.append(more[0])
            rings = more[1] if rings is None else rings.unionByName(more[1])
            left = live.count()
        if left > WORTH * before:
            break
    loops = live.filter("src = dst").select(F.col("src").alias("node"))
    found = core(live.filter("src <> dst"))
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("scc"))
    found = found.unionByName(alone)
    found = stored(found if rings is None else found.unionByName(rings), "strong")
    for tied in reversed(chains):  # a chain is on a cycle where its ends are on the same
        head, tail = found.select(F.col("node").alias("head"), "scc"), found.select(F.col("node").alias("tail"), F.col("scc").alias("other"))
        found = stored(found.unionByName(tied.join(head, "head").join(tail, "tail").filter("scc = other").select("node", "scc")), "strong")
    return found


def core(live: DataFrame) -> DataFrame:
    """(node, scc) of edges without self-loops, by names: each takes the greatest that leads to it; those from which its bearer is reached back are one with it."""
    found = None
    while live.count():
        names = stored(live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct(), "names")
        name = graph.spread(names.select("node", F.col("node").alias("v")), live, F.max)
        ours, theirs = name.select(F.col("node").alias("src"), F.col("v").alias("name")), name.select(F.col("node").alias("dst"), F.col("v").alias("other"))
        inside = stored(live.join(ours, "src").join(theirs, "dst").filter("name = other").select("src", "dst"), "inside")
        back = graph.spread(name.select("node", (F.col("node") == F.col("v")).alias("v")), graph.reversed_edges(inside), F.max)
        whole = stored(name.join(back.filter("v").select("node"), "node").select("node", F.col("v").alias("scc")), "whole")
        many = whole.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1").select("scc")
        one = whole.join(many, "scc", "left_semi").select("node", "scc")
        found = stored(one if found is None else found.unionByName(one), "core")
        gone = whole.select("node")
        live = trimmed(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return live.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    return found


def components(e: DataFrame) -> tuple[DataFrame, int]:
    """(node, component) of edges (src, dst) taken both ways, named by the least node; and how many rounds that took.

    In each round every tree hooks itself onto a neighbouring tree by the first of its edges in an order of
    edges drawn anew for the round, and points to the root of what that makes; so at least half of the trees
    go, a star in one round, whatever the graph is like.  A round works on the roots that are left and the
    different edges between them only; what nodes pointed to is put together at the end.
    """
    e = e.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    edges = stored(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "edges")
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    edges, levels = edges.filter("a <> b"), []
    while not edges.isEmpty():
        levels.append(hooked(edges, len(levels)))
        pointer = levels[-1].filter("node <> root")
        at = lambda df, c: df.join(pointer.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to")), c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")  # noqa: B023, E731
        between = at(at(edges, "a"), "b").filter("a <> b")
        edges = stored(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "between")
    if not levels:
        return loops.select("node", F.col("node").alias("component")), 0
    tree = levels[-1]
    for own in reversed(levels[:-1]):  # where a root of this level went later
        later = tree.select(F.col("node").alias("root"), F.col("root").alias("last"))
        tree = stored(own.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "tree")
    names = tree.groupBy("root").agg(F.min("node").alias("component"))
    alone = loops.join(tree.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return tree.join(names, "root").select("node", "component").unionByName(alone), len(levels)


def hooked(edges: DataFrame, draw: int) -> DataFrame:
    """(node, root): nodes of different edges (a, b) grouped along the first edge of each, in an order drawn by a number; roots point to themselves.

    Along hooks edges only come earlier, so two nodes that hook onto each other are the only cycles; of
    these the one with more edges is the root.
    """
    drawn = edges.withColumn("first", F.xxhash64("a", "b", F.lit(draw)))
    ends = drawn.select(F.col("a").alias("node"), F.col("b").alias("to"), "first").unionByName(drawn.select(F.col("b").alias("node"), F.col("a").alias("to"), "first"))
    order = F.struct("first", F.least("node", "to"), F.greatest("node", "to"))
    hooks = stored(ends.groupBy("node").agg(F.min_by("to", order).alias("to"), F.count("*").alias("n")), "hooks")
    theirs = hooks.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("n").alias("m"))
    ours = (F.col("beyond") == F.col("node")) & ((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("to"))))
    both = stored(hooks.join(theirs, "to").select("node", "to", ours.alias("top")), "pointers")
    roots = both.filter("top").select("node", F.col("node").alias("root"))
    return stored(jumped(both.filter("NOT top").select("node", "to"))[0].select("node", F.col("to").alias("root")).unionByName(roots), "roots")
