"""Ranking operators against plain Python, on awkward rows."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import ranking

SCHEMA = "query_id long, id long, x double, y double, z double, label int"


def judged(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.randrange(5), i, rng.random(), rng.gauss(0, 1), 1.0, rng.choice([0, 0, 1, 2, 3])) for i in range(n)]
    return rows + [rows[0], (9, 1000, 0.5, 0.5, 1.0, 1), (1, 1001, None, 0.1, 1.0, 2), (1, 1002, 0.1, 0.1, 1.0, None), (None, 1003, 0.1, 0.2, 1.0, 1)]


def test_moments_and_weights_are_those_of_all_pairs(spark):
    rows = judged(3)
    whole = [r for r in rows if None not in r]
    pairs = np.array([np.subtract(a[2:5], b[2:5]) for a, b in itertools.product(whole, whole) if a[0] == b[0] and a[5] > b[5]])
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ranking.pair_moments(frame, ["x", "y", "z"]).first().asDict()
    assert got["n"] == len(pairs)
    a, b = pairs.T @ pairs, pairs.sum(0)
    for i, j in itertools.combinations_with_replacement(range(3), 2):
        assert abs(got[f"a_{i}_{j}"] - a[i, j]) < 1e-6
    assert np.allclose([got[f"b_{i}"] for i in range(3)], b)
    want = np.linalg.solve(a / len(pairs) + 0.01 * np.eye(3), b / len(pairs))
    assert np.allclose(ranking.learned(frame, ["x", "y", "z"], ridge=0.01), want)
    assert ranking.learned(frame.filter("label = 1"), ["x"]) == [0.0] and ranking.learned(frame.limit(0), ["x", "y"]) == [0.0, 0.0]


def test_learning_finds_the_feature_that_tells(spark):
    rng = random.Random(1)
    rows = [(q, 100 * q + i, float(i % 3 == 0) + rng.gauss(0, 0.1), rng.gauss(0, 5), 0.0, int(i % 3 == 0)) for q in range(8) for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    weights = ranking.learned(frame, ["x", "y"])
    assert weights[0] > 0.5 and abs(weights[1]) < 0.05
    ranked = ranking.search.best(ranking.scored(frame, ["x", "y"], weights), 10, "query_id")
    assert all(r["ndcg"] == 1.0 for r in ranking.ndcg(ranked.join(frame.select("id", F.col("label").alias("l")), "id").drop("label").withColumnRenamed("l", "label")).collect())


def test_gain_of_rankings(spark):
    hits = [(1, 10, 1, 0), (1, 11, 2, 3), (1, 12, 3, 1), (2, 10, 1, 0), (2, 11, 2, None), (3, 10, 1, 2)]
    got = {r["query_id"]: r["ndcg"] for r in ranking.ndcg(spark.createDataFrame(hits, "query_id long, id long, rank int, label int"), 2).collect()}
    assert got == {1: round((7 / np.log2(3)) / (7 + 1 / np.log2(3)), 6), 2: 0.0, 3: 1.0}


def test_scales_and_boosts(spark):
    hits = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 3.0), (2, 1, 5.0)], "query_id long, id long, score double")
    got = ranking.boosted(ranking.normalised(hits), [(F.col("id") == 3, 1.5), (F.when(F.col("id") == 9, True), 7.0), (F.col("id") > 1, 2.0)])
    assert {(r["query_id"], r["id"]): r["score"] for r in got.collect()} == {(1, 1): 0.0, (1, 2): 2.0, (1, 3): 1.5, (2, 1): 1.0}


def test_diversity(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, None), (6, [0.0, 0.0])], "id long, vector array<double>")
    hits = spark.createDataFrame([(7, 1, 0.9), (7, 2, 0.89), (7, 3, 0.5), (7, 4, 0.1), (8, 2, 0.3), (8, 5, 0.3), (8, 6, 0.2)], "query_id long, id long, score double")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in ranking.diverse(hits, points, 3, 0.5).collect())
    assert got == [(7, 1, 1, 0.45), (7, 2, 3, 0.25), (7, 3, 4, 0.05), (8, 1, 2, 0.15), (8, 2, 5, 0.15), (8, 3, 6, 0.1)]
    assert ranking.diverse(hits.limit(0), points).collect() == []
    alone = ranking.diverse(hits, points.limit(0), 2, 1.0)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in alone.collect()) == [(7, 1, 1), (7, 2, 2), (8, 1, 2), (8, 2, 5)]


def test_windows_from_the_end(spark):
    """A hit rises through overlapping windows; without overlap it stays within its own."""
    scores = [5, 1, None, 4, 2, 9]
    hits = spark.createDataFrame([(1, i, i + 1, s) for i, s in enumerate(scores)] + [(2, 0, 1, 1)], "query_id long, id long, rank long, better int")
    order = lambda df: [r["id"] for r in sorted(df.filter("query_id = 1").collect(), key=lambda r: r["rank"])]
    assert order(ranking.in_windows(hits, "better", 3, 2)) == [5, 0, 1, 2, 3, 4]
    assert order(ranking.in_windows(hits, "better", 3, 3)) == [0, 1, 2, 5, 3, 4]
    assert order(ranking.in_windows(hits, "better", 9, 5)) == [5, 0, 3, 4, 1, 2]
