"""Queries over graphs; the star schema and line items stand for files, symbols and their uses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import contract, graph, search
from lodestone.operators.tables import stored
from lodestone.plans.search import METRIC, QUERY_VECTORS, points, vector_queries
from lodestone.plans.shared import CHUNKS_SQL, query


@query("SELECT 'p' || l_partkey AS dst, count(DISTINCT 'o' || l_orderkey) AS dependents FROM lineitem GROUP BY l_partkey")
def reverse_dependencies(load, spark):
    """How many depend on each."""
    items = load("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return items.groupBy("dst").agg(F.count("*").alias("dependents"))


STAR_SQL = """e AS (SELECT DISTINCT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'PLACED_BY' AS type FROM orders UNION
SELECT DISTINCT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION' FROM customer UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey, 'IN_REGION' FROM nation)"""


def star(load):
    def keyed(table, a, x, b, y):
        return load(table).select(F.concat(F.lit(a), x).alias("s"), F.concat(F.lit(b), y).alias("d"))

    return graph.edges(
        (keyed("orders", "o", "o_orderkey", "c", "o_custkey"), "s", "d", "PLACED_BY"),
        (keyed("customer", "c", "c_custkey", "n", "c_nationkey"), "s", "d", "IN_NATION"),
        (keyed("nation", "n", "n_nationkey", "r", "n_regionkey"), "s", "d", "IN_REGION"),
    )


@query(f"WITH {STAR_SQL} SELECT src, dst, type FROM e")
def graph_edges(load, spark):
    """P4, P11."""
    return star(load)


@query(f"""WITH {STAR_SQL}, o AS (SELECT src AS node, count(*) AS dependencies FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS dependents FROM e GROUP BY dst)
SELECT node, coalesce(dependencies, 0) AS dependencies, coalesce(dependents, 0) AS dependents FROM o FULL JOIN i USING (node)""")
def dependency_hierarchy(load, spark):
    """P3."""
    return graph.direct(star(load))


WALK = """WITH RECURSIVE {0}, walk(start, node, depth) AS (SELECT DISTINCT src, src, 0 FROM s UNION SELECT w.start, s.dst, w.depth + 1 FROM walk w JOIN s ON s.src = w.node WHERE w.depth < {1}),
reach AS (SELECT start, node, min(depth) :: INT AS depth FROM walk GROUP BY start, node)"""


@query(WALK.format(STAR_SQL + ", s AS (SELECT src, dst FROM e)", 3) + " SELECT start, node, depth FROM reach")
def graph_dependents_depth(load, spark):
    """P5: all that each node leads to, by depth."""
    e = star(load)
    return graph.reach(e, e.select(F.col("src").alias("start")).distinct(), 3)


@query(WALK.format(STAR_SQL + ", s AS (SELECT dst AS src, src AS dst FROM e)", 3) + " SELECT start, count(*) AS impacted FROM reach WHERE depth > 0 GROUP BY start")
def graph_impact(load, spark):
    """How many each node's change reaches, up to three hops back."""
    e = graph.reversed_edges(star(load))
    return graph.reach(e, e.select(F.col("src").alias("start")).distinct(), 3).filter("depth > 0").groupBy("start").agg(F.count("*").alias("impacted"))


UNDIRECTED = STAR_SQL + ", t AS (SELECT src, dst FROM e), s AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t)"


@query(f"""WITH RECURSIVE {UNDIRECTED}, walk(node, depth) AS (SELECT 'r0', 0 UNION SELECT s.dst, w.depth + 1 FROM walk w JOIN s ON s.src = w.node WHERE w.depth < 4) SELECT node, min(depth) :: INT AS distance FROM walk GROUP BY node""")
def graph_shortest_path(load, spark):
    """Distances from one node, edges taken both ways."""
    e = graph.both_ways(star(load))
    start = spark.createDataFrame([("r0",)], "start string")
    return graph.reach(e, start, 4).select("node", F.col("depth").alias("distance"))


@query(f"""WITH RECURSIVE {UNDIRECTED}, walk(node, depth) AS (SELECT 'r0', 0 UNION SELECT s.dst, w.depth + 1 FROM walk w JOIN s ON s.src = w.node WHERE w.depth < 4),
near AS (SELECT node, min(depth) AS d FROM walk GROUP BY node), parent AS (SELECT n.node, n.d, min(s.src) AS p FROM near n JOIN s ON s.dst = n.node JOIN near m ON m.node = s.src AND m.d = n.d - 1 GROUP BY n.node, n.d),
way(node, path) AS (SELECT 'r0', 'r0' UNION ALL SELECT parent.node, path || ' ' || parent.node FROM way JOIN parent ON parent.p = way.node)
SELECT node, path FROM way""")
def graph_paths(load, spark):
    """The ways themselves, from one node."""
    start = spark.createDataFrame([("r0",)], "start string")
    return graph.paths(graph.both_ways(star(load)), start, 4).select("node", F.array_join("path", " ").alias("path"))


@query(f"""WITH RECURSIVE {UNDIRECTED}, u AS (SELECT src, dst FROM s WHERE NOT starts_with(src, 'n') AND NOT starts_with(dst, 'n')), walk(node, least) AS (SELECT src, src FROM u UNION SELECT u.dst, w.least FROM walk w JOIN u ON u.src = w.node)
SELECT node, min(least) AS component FROM walk GROUP BY node""")
def graph_components(load, spark):
    """What hangs together: customers and their orders, without nations."""
    e = star(load).filter(~F.col("src").startswith("n") & ~F.col("dst").startswith("n"))
    return contract.components(e)[0]


TIES_SQL = """e AS (SELECT doc_id AS src, (doc_id * 7 + 3) % 64 AS dst FROM documents WHERE doc_id % 5 <> 0 UNION SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id % 11 <> 0 UNION SELECT item_id + 100, item_id + 90 FROM benchmark)"""


@query(f"""WITH RECURSIVE {TIES_SQL}, walk(start, node) AS (SELECT src, dst FROM e UNION SELECT w.start, e.dst FROM walk w JOIN e ON e.src = w.node) SELECT DISTINCT start AS node FROM walk WHERE start = node""")
def graph_cycles(load, spark):
    """Nodes on a cycle of any length, in a graph of ties between documents and items."""
    doc, item = F.col("doc_id"), F.col("item_id")
    ties = load("documents").filter(doc % 5 != 0).select(doc.alias("src"), ((doc * 7 + 3) % 64).alias("dst"))
    ties = ties.unionByName(load("documents").filter(doc % 11 != 0).select(doc.alias("src"), F.floor(doc / 3).alias("dst")))
    return graph.cycles(ties.unionByName(load("benchmark").select((item + 100).alias("src"), (item + 90).alias("dst"))))


NEAREST = f"""near AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
(SELECT query_id, vec_id AS id, round({METRIC['cosine']}, 6) AS score FROM (SELECT vec_id, embedding AS v FROM embeddings), ({QUERY_VECTORS}))) WHERE rank <= 5),
uses AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"""


@query(f"WITH {NEAREST} SELECT query_id, id, 0 AS depth FROM near UNION SELECT query_id, dst, 1 FROM near JOIN uses ON src = id WHERE (query_id, dst) NOT IN (SELECT query_id, id FROM near)")
def graph_expand(load, spark):
    """Nearest points, and what they are tied to."""
    near = search.dense(points(load), vector_queries(load), 5).select("query_id", "id")
    uses = load("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    more = near.join(uses, F.col("id") == F.col("src")).select("query_id", F.col("dst").alias("id")).distinct().join(near, ["query_id", "id"], "left_anti")
    return near.withColumn("depth", F.lit(0)).unionByName(more.withColumn("depth", F.lit(1)))


@query(f"""WITH {NEAREST}, tied AS (SELECT query_id, dst AS id, 1 AS depth FROM near JOIN uses ON src = id UNION SELECT query_id, id, 0 FROM near), least AS (SELECT query_id, id, min(depth) AS depth FROM tied GROUP BY query_id, id)
SELECT l.query_id, l.id, round(0.6 :: DOUBLE * coalesce(score, 0) + 0.2 :: DOUBLE * (1.0 :: DOUBLE / (depth + 1)) + 0.2 :: DOUBLE * (CASE WHEN label IS NULL THEN 0.0 ELSE label / 10.0 END), 8) AS score
FROM least l LEFT JOIN near n ON n.query_id = l.query_id AND n.id = l.id LEFT JOIN embeddings ON vec_id = l.id""")
def graph_rerank(load, spark):
    """Vector score, proximity in the graph and importance together."""
    near = search.dense(points(load), vector_queries(load), 5).select("query_id", "id", "score")
    uses = load("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    tied = near.join(uses, F.col("id") == F.col("src")).select("query_id", F.col("dst").alias("id"), F.lit(1).alias("depth"))
    least = tied.unionByName(near.select("query_id", "id", F.lit(0).alias("depth"))).groupBy("query_id", "id").agg(F.min("depth").alias("depth"))
    both = least.join(near, ["query_id", "id"], "left").join(points(load).select("id", "label"), "id", "left")
    score = F.lit(0.6) * F.coalesce("score", F.lit(0.0)) + F.lit(0.2) * graph.proximity(F.col("depth")) + F.lit(0.2) * F.coalesce(F.col("label") / F.lit(10.0), F.lit(0.0))
    return both.select("query_id", "id", F.round(score, 8).alias("score"))


@query("""SELECT doc_id, lang, total FROM (SELECT doc_id, lang, sum(length(text) // 4) OVER (PARTITION BY lang ORDER BY importance DESC, doc_id ROWS UNBOUNDED PRECEDING) :: BIGINT AS total FROM
(SELECT doc_id, lang, text, length(text) - length(replace(text, '. ', '')) AS importance FROM documents)) WHERE total <= 8192""")
def context_budget(load, spark):
    """The best documents of each language until the token budget is first exceeded."""
    rows = load("documents").select("doc_id", "lang", T.token_estimate(F.col("text")).alias("tokens"), (F.length("text") - F.length(F.replace("text", F.lit(". "), F.lit("")))).alias("importance"))
    return graph.within_budget(rows, "tokens", 8192, "importance", "doc_id", "lang").select("doc_id", "lang", "total")


@query("""SELECT nearest, count(*) AS n FROM (SELECT arg_max(c.label, (round(list_cosine_similarity(p.embedding :: DOUBLE[], c.embedding :: DOUBLE[]), 6), -c.label)) AS nearest
FROM embeddings p, (SELECT label, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) c GROUP BY p.vec_id) GROUP BY nearest""")
def nearest_collection(load, spark):
    """Points by the collection whose first member is nearest; the few heads are broadcast."""
    heads = stored(points(load).groupBy("label").agg(F.min_by("vector", "id").alias("head")).select(F.col("label").alias("l"), "head"), "heads")
    scores = points(load).select("id", "vector").join(search.small(heads)).select("id", "l", F.round(V.cosine(F.col("vector"), F.col("head")), 6).alias("s"))
    best = scores.groupBy("id").agg(F.max_by("l", F.struct("s", -F.col("l"))).alias("nearest"))
    return best.groupBy("nearest").agg(F.count("*").alias("n"))
