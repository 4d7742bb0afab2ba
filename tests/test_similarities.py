"""Similarities of all points and stated queries: vectors that are missing, hold nulls, are zero or of other dimensions."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import nearest, search

VECTORS = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, []), (7, [-3.0, 0.5]), (8, [0.0, 0.0, 0.0]), (9, [1e-3, 7.0])]


def test_each_pair_once_by_matrix_products(spark):
    points = spark.createDataFrame(VECTORS, "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame(VECTORS, "query_id long, query array<double>")
    found = search.similarities(points, queries)
    assert "PythonMapInArrow" in (plan := found._jdf.queryExecution().toString()) or "MapInArrow" in plan
    plain = points.join(F.broadcast(queries)).select("query_id", "id", F.round(V.cosine(F.col("vector"), F.col("query")), 6).alias("score"))
    key = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[:2])
    assert key(found) == key(plain)
    assert search.similarities(points, queries.limit(0)).collect() == [] and search.similarities(points.limit(0), queries).collect() == []


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MOST_QUERIES", 7)
    x = np.random.default_rng(3).normal(size=(40, 5)).tolist()
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, vector array<double>")
    found = search.similarities(points, points.select(F.col("id").alias("query_id"), F.col("vector").alias("query")))
    assert found.count() == 1600 and found.dropDuplicates(["query_id", "id"]).count() == 1600
