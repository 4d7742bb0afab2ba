"""Cycles and components against plain Python; long chains and rings in few rounds."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import contract, graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def reachable(pairs):
    nodes, out = {x for p in pairs for x in p}, {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = {}
    for n in nodes:
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        found[n] = seen
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_of_mixed_graphs(spark, seed):
    """Random edges, rings hanging on them, loops, chains between and beyond, two rings in one node."""
    rng = random.Random(seed)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(24)]
    pairs += [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(3, 103)]
    pairs += [(200 + i, 201 + i) for i in range(12)] + [(212, 0), (1, 200)]
    pairs += [(300, 301), (301, 302), (302, 300), (302, 310), (310, 311), (311, 302), (400, 400), (500, 501), (501, 502), (502, 500)]
    reach = reachable(pairs)
    got = {r["node"]: r["scc"] for r in contract.strong(frame(spark, [*pairs, pairs[0]])).collect()}
    assert set(got) == {n for n in reach if n in reach[n]}
    assert all((got[a] == got[b]) == (b in reach[a] and a in reach[b]) for a in got for b in got)


def test_nothing_and_null_edges(spark):
    assert contract.strong(frame(spark, [])).collect() == []
    assert contract.strong(frame(spark, [(1, 2), (2, None), (None, 1)])).collect() == []
    assert contract.components(frame(spark, []))[0].collect() == []


def test_ten_thousand_nodes_in_a_row_and_in_a_ring(spark):
    n = 10_000
    row = spark.range(n - 1).select(F.col("id").alias("node"), (F.col("id") + 1).alias("to"))
    ends, rounds = contract.jumped(row)
    assert rounds < 20 and ends.filter("NOT ends OR to <> 9999").count() == 0
    both = row.select(F.col("node").alias("src"), F.col("to").alias("dst")).unionByName(spark.range(n).select((F.col("id") + n).alias("src"), ((F.col("id") + 1) % n + n).alias("dst")))
    found = contract.strong(both)
    assert (found.count(), found.filter("node >= 10000").count(), found.select("scc").distinct().count()) == (n, n, 1)


def test_components_in_few_rounds(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(7, 7), (9000, 9000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got, rounds = contract.components(frame(spark, pairs))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in list(root)} and rounds < 12


def test_paths_name_the_way(spark):
    e = frame(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1), (6, 1)])
    got = {r["node"]: (r["distance"], r["path"]) for r in graph.paths(e, spark.createDataFrame([(1,)], "start long"), 9).collect()}
    assert got == {1: (0, [1]), 2: (1, [1, 2]), 3: (1, [1, 3]), 4: (2, [1, 2, 4]), 5: (3, [1, 2, 4, 5])}


def test_components_of_stars_in_one_round(spark):
    """Stars, whose leaves have one edge each; later rounds work on what is left only."""
    pairs = [(100 * (k % 10), k) for k in range(3000) if k % 100 or k >= 1000]
    got, rounds = contract.components(frame(spark, pairs))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: k % 10 for _, k in pairs} | {a: a // 100 for a, _ in pairs} and rounds == 1


def test_components_with_loops_and_holes(spark):
    got, _ = contract.components(frame(spark, [(1, 1), (2, 3), (3, 3), (None, 4), (5, None), (3, 2), (2, 3)]))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(1, 1), (2, 2), (3, 2)}
