"""Operators against plain Python on small awkward inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, nearest, search


def test_nearest_with_ties_holes_and_groups(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)], rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(300, None, "a"), (301, [1.0], "a"), (302, [1.0, None, 1.0, 1.0], "b"), (303, [0.0] * 4, "b"), (None, [1.0] * 4, "a")]
    points = spark.createDataFrame(rows, "id long, vector array<double>, label string").repartition(3)
    asked = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(7)] + [(7, [0.0] * 4)]
    queries = spark.createDataFrame([*asked, (8, None)], "query_id long, query array<double>")
    monkeypatch.setattr(nearest, "MOST_QUERIES", 3)

    def score(metric, x, q):
        dot = sum(a * b for a, b in zip(x, q, strict=True))
        size = (sum(a * a for a in x) * sum(b * b for b in q)) ** 0.5
        return {"cosine": dot / size if size else 0.0, "dot": dot, "euclid": sum((a - b) ** 2 for a, b in zip(x, q, strict=True)) ** 0.5, "manhattan": sum(abs(a - b) for a, b in zip(x, q, strict=True))}[metric]

    good = [(i, v, g) for i, v, g in rows if i is not None and v and len(v) == 4 and None not in v]
    for metric, (_, more) in nearest.METRICS.items():
        for by in (False, True):
            want = set()
            for k, q in asked:
                for names in [["a"], ["b"], [None]] if by else [["a", "b", None]]:
                    own = sorted(((-1 if more else 1) * round(score(metric, v, q), 6), i) for i, v, g in good if g in names)
                    want |= {(k, i, r + 1) for r, (_, i) in enumerate(own[:9])}
            got = search.dense_by(points, queries, 9, "label", metric) if by else search.dense(points, queries, 9, metric)
            assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want
    assert search.dense(points.limit(0), queries, 3).count() == 0 and search.dense(points, queries.limit(0), 3).count() == 0


def test_nearest_of_named_points(spark):
    points = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    got = search.dense(points, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>"), 2)
    assert [(r["id"], r["score"]) for r in got.orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0)]


def test_index_counts_terms(spark):
    docs = spark.createDataFrame([(1, "b a B é a b"), (2, None), (3, " "), (4, "x")], "id long, text string")
    own = search.index(docs)
    assert sorted((r["id"], r["dl"], r["term"], r["tf"]) for r in search.postings(own).collect()) == [(1, 6, "a", 2), (1, 6, "b", 3), (1, 6, "é", 1), (4, 1, "x", 1)]
    assert tuple(search.corpus_stats(own).first())[:2] == (4, 7)
    asked = spark.createDataFrame([(0, "zzz"), (1, "")], "query_id long, text string")
    assert search.sparse(own, asked, 3).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_cycles_of_any_length(spark, seed):
    rng = random.Random(seed)
    n = 30
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([15, 25, 40]))} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(200 + i, 201 + i) for i in range(5)}
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    for _ in range(8):
        reach = {a: own | set().union(*(reach.get(b, set()) for b in own)) for a, own in reach.items()}
    got = {r["node"] for r in graph.cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == {a for a, own in reach.items() if a in own}


def test_reach_and_budget(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")], "src string, dst string")
    got = graph.reach(e, spark.createDataFrame([("a",), ("x",)], "start string"), 9)
    assert {tuple(r) for r in got.collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "x", 0)}
    rng = random.Random(3)
    rows = [(i, rng.choice(["p", "q", None]), rng.randrange(0, 9), rng.choice([1, 2, 2, 3])) for i in range(400)] + [(900, "r", 50, 1), (901, "s", 3, 1)]
    want = set()
    for g in ("p", "q", "r", "s", None):
        total = 0
        for i, _, size, _ in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[0])):
            total += size
            if total <= 40:
                want.add((i, total))
    got = graph.within_budget(spark.createDataFrame(rows, "id long, g string, size long, score long").repartition(3), "size", 40, "score", "id", "g")
    assert {(r["id"], r["total"]) for r in got.collect()} == want


def test_features_of_odd_texts(spark):
    """Blank lines by all that counts as space, words beside letters that aren't ASCII; no line goes through a pattern."""
    texts = ["", "\n \n\t\x0b\f\r\n", "a\n\n b \n \n", "éif if ifé ñclass class x", "class é", "subclass x", "def\n\nf function", "function  g", "undef f", "forif while", None]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, code string")
    got = table.select("k", *[c.alias(n) for n, c in T.code_features(F.col("code"), F.lit("python")).items()])
    rows = [(r["has_classes"], r["has_functions"], r["line_count"], r["branch_words"]) for r in got.orderBy("k").collect()]
    space = " \t\n\x0b\f\r"
    assert rows[:-1] == [
        (bool(re.search(r"\bclass[ \t\n\x0b\f\r\u0085  - ]+\w", t)), bool(re.search(r"\b(def|function)\s+\w", t)), sum(line.strip(space) != "" for line in t.split("\n")), len(re.findall(r"\b(?:if|for|while|def|class)\b", t))) for t in texts[:-1]
    ]
    assert rows[-1] == (None,) * 4
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
