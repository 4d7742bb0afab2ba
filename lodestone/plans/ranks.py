"""Queries that learn, judge, boost and diversify rankings of points; a hit is relevant if it has the query's label."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import ranking, search
from lodestone.operators.tables import stored
from lodestone.plans.search import METRIC, dense_sql, points, vector_queries
from lodestone.plans.shared import query

FEATURES = ["cosine", "place"]
SHARE, RIDGE = 0.7, 1e-3

GRADED = f"""hits AS ({dense_sql(50)}),
g AS (SELECT query_id, id, score, rank, score AS cosine, 1.0 :: DOUBLE / rank AS place, coalesce((p.label = q.label) :: INT, 0) AS label, p.label AS own FROM hits JOIN embeddings p ON p.vec_id = id JOIN embeddings q ON q.vec_id = query_id)"""
MOMENTS = f"""{GRADED},
d AS (SELECT a.cosine - b.cosine AS x, a.place - b.place AS y FROM g a JOIN g b ON a.query_id = b.query_id AND a.label > b.label),
m AS (SELECT count(*) :: DOUBLE AS n, sum(x) AS b0, sum(y) AS b1, sum(x * x) AS a00, sum(x * y) AS a01, sum(y * y) AS a11 FROM d)"""


def graded(load):
    """(query_id, id, score, rank, cosine, place, label, own): the first fifty of each query, and whether they have its label."""
    hits = search.dense(points(load), vector_queries(load), 50)
    theirs = load("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("own"))
    asked = load("embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    rows = stored(hits.select("query_id", "id", "score", F.col("rank").cast("int").alias("rank")), "hits")
    both = theirs.join(search.small(rows), "id").join(asked, "query_id")
    return both.select("query_id", "id", "score", "rank", F.col("score").alias("cosine"), (F.lit(1.0) / F.col("rank")).alias("place"), F.coalesce((F.col("own") == F.col("wanted")).cast("int"), F.lit(0)).alias("label"), "own")


@query(f"WITH {MOMENTS} SELECT n, round(b0, 5) AS b_0, round(b1, 5) AS b_1, round(a00, 5) AS a_0_0, round(a01, 5) AS a_0_1, round(a11, 5) AS a_1_1 FROM m")
def ranking_moments(load, spark):
    """What learning needs of all pairs of hits, taken without making pairs."""
    sums = ranking.pair_moments(graded(load), FEATURES)
    return sums.select("n", *[F.round(c, 5).alias(c) for c in sums.columns if c != "n"])


@query(f"""WITH {MOMENTS},
s AS (SELECT n, b0 / n AS b0, b1 / n AS b1, a00 / n + {RIDGE} :: DOUBLE AS a00, a01 / n AS a01, a11 / n + {RIDGE} :: DOUBLE AS a11 FROM m),
w AS (SELECT (b0 * a11 - b1 * a01) / (a00 * a11 - a01 * a01) AS w0, (b1 * a00 - b0 * a01) / (a00 * a11 - a01 * a01) AS w1 FROM s)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) :: INT AS rank FROM (SELECT query_id, id, round(cosine * w0 + place * w1, 6) AS score FROM g, w)) WHERE rank <= 10""")
def learned_ranking(load, spark):
    """Hits ranked by weights learned from labelled hits."""
    rows = stored(graded(load), "graded")
    return search.best(ranking.scored(rows, FEATURES, ranking.learned(rows, FEATURES, ridge=RIDGE)).select("query_id", "id", "score"), 10, "query_id")


@query(f"""WITH {GRADED}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, id) AS ideal FROM g),
t AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, label) - 1) / log2(rank + 1) ELSE 0 END) AS got, sum(CASE WHEN ideal <= 10 THEN (pow(2, label) - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM i GROUP BY query_id)
SELECT query_id, round(CASE WHEN best > 0 THEN got / best ELSE 0 END, 6) AS ndcg FROM t""")
def ranking_quality(load, spark):
    """The discounted gain of each query's first ten hits."""
    return ranking.ndcg(graded(load), 10)


@query(f"""WITH {GRADED}, n AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS low, max(score) OVER (PARTITION BY query_id) AS high FROM g)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) :: INT AS rank FROM
(SELECT query_id, id, round(CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1.0 END * CASE WHEN own < 3 THEN 1.25 :: DOUBLE ELSE 1 END * CASE WHEN id % 2 = 0 THEN 1.1 :: DOUBLE ELSE 1 END, 6) AS score FROM n)) WHERE rank <= 10""")
def boosted_ranking(load, spark):
    """Scores brought to one scale, and boosted by metadata."""
    rows = ranking.boosted(ranking.normalised(graded(load)), [(F.col("own") < 3, 1.25), (F.col("id") % 2 == 0, 1.1)])
    return search.best(rows.select("query_id", "id", "score"), 10, "query_id")


@query(f"""WITH RECURSIVE {GRADED}, c AS (SELECT query_id, id, score, embedding AS v FROM g JOIN embeddings ON vec_id = id),
alike AS (SELECT a.query_id, a.id AS a, b.id AS b, {METRIC['cosine'].replace('v ::', 'a.v ::').replace('q ::', 'b.v ::')} AS s FROM c a JOIN c b ON a.query_id = b.query_id),
pick(query_id, id, score, rank, taken) AS (
  SELECT query_id, id, round({SHARE} :: DOUBLE * score, 6), 1, [id] FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM c) WHERE r = 1
  UNION ALL
  SELECT query_id, id, gain, n + 1, list_append(taken, id) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, score DESC, id) AS r FROM (
      SELECT p.query_id, c.id, c.score, any_value(p.rank) AS n, any_value(p.taken) AS taken, round({SHARE} :: DOUBLE * c.score - (1 - {SHARE} :: DOUBLE) * max(s), 6) AS gain
      FROM pick p JOIN c ON c.query_id = p.query_id JOIN alike ON alike.query_id = p.query_id AND a = c.id AND list_contains(p.taken, b)
      WHERE p.rank < 10 AND NOT list_contains(p.taken, c.id) GROUP BY p.query_id, c.id, c.score)) WHERE r = 1)
SELECT query_id, id, score, rank :: INT AS rank FROM pick""")
def diverse_topk(load, spark):
    """Ten of the first fifty that are relevant and differ, by maximal marginal relevance."""
    return ranking.diverse(graded(load).select("query_id", "id", "score"), points(load), 10, SHARE)
