"""Queries over vectors and postings: search, fusion, reranking, embedding quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import ann, inverted, quantised, rerank, search, validate
from lodestone.operators.tables import new_folder, stored
from lodestone.plans.code import CHUNKS_SQL, DETECTED, counted, worded
from lodestone.plans.shared import chunks, query

EVERY = 50  # rows whose number this divides are the queries


def points(load):
    return load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(load):
    return load("embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def texts(load):
    return load("documents").select(F.col("doc_id").alias("id"), "text")


def indexed(load):
    return search.index(texts(load))


def inverted_index(load):
    """The stored inverted index of the documents, built by the first query that needs it."""
    return inverted.kept(load.spark, load.path("documents"), texts(load))


def text_queries(load):
    return load("benchmark").select(F.col("item_id").alias("query_id"), "text")


def item_vectors(load):
    """The vectors that stand for the text queries: those with the items' numbers."""
    asked = load("benchmark").select(F.col("item_id").alias("query_id"))
    return load("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).join(asked, "query_id", "left_semi")


# ---------------------------------------------------------------- SQL

METRIC = {
    "cosine": "list_cosine_similarity(v :: DOUBLE[], q :: DOUBLE[])",
    "dot": "list_inner_product(v :: DOUBLE[], q :: DOUBLE[])",
    "euclid": "list_distance(v :: DOUBLE[], q :: DOUBLE[])",
    "manhattan": "list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] :: DOUBLE - z[2] :: DOUBLE)))",
}
QUERY_VECTORS = f"SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % {EVERY} = 0"
ITEM_VECTORS = "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)"


def dense_sql(most: int, metric: str = "cosine", queries: str = QUERY_VECTORS, where: str = "true", by: str = "", columns: str = "") -> str:
    down = "DESC" if metric in ("cosine", "dot") else "ASC"
    return f"""SELECT query_id, id, score, rank{columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id{by} ORDER BY score {down}, id) :: INT AS rank FROM
(SELECT query_id, vec_id AS id, label, round({METRIC[metric]}, 6) AS score FROM (SELECT vec_id, label, embedding AS v FROM embeddings WHERE {where}), ({queries}))) WHERE rank <= {most}"""


TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
BM25_OWN = f"""d AS (SELECT doc_id AS id, {TERMS} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY id, term),
idf AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5 :: DOUBLE) / (count(*) + 0.5 :: DOUBLE) + 1.0 :: DOUBLE) AS idf, any_value(avgdl) AS avgdl FROM tf, stats GROUP BY term),
w AS (SELECT id, term, idf * tf * (2.2 :: DOUBLE) / (tf + 1.2 :: DOUBLE * (0.25 :: DOUBLE + 0.75 :: DOUBLE * dl / avgdl)) AS w FROM tf JOIN idf USING (term))"""
BM25 = f"""{BM25_OWN},
asked AS (SELECT query_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT query_id, len(t) AS dl, unnest(t) AS term FROM (SELECT item_id AS query_id, {TERMS} AS t FROM benchmark)) GROUP BY query_id, term),
qw AS (SELECT query_id, term, idf * tf * (2.2 :: DOUBLE) / (tf + 1.2 :: DOUBLE * (0.25 :: DOUBLE + 0.75 :: DOUBLE * dl / avgdl)) AS q FROM asked JOIN idf USING (term)),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) :: INT AS rank FROM (SELECT query_id, id, round(sum(w * q), 6) AS score FROM w JOIN qw USING (term) GROUP BY query_id, id)),
classic AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) :: INT AS rank FROM (SELECT query_id, id, round(sum(w), 6) AS score FROM w JOIN asked USING (term) GROUP BY query_id, id))"""
LEGS = f"{BM25}, dense AS ({dense_sql(50, queries=ITEM_VECTORS)})"


def fused_sql(dense: float, sparse: float, most: int = 10) -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) :: INT AS rank FROM
(SELECT query_id, id, round(sum(part), 6) AS score FROM (SELECT query_id, id, {dense} :: DOUBLE / (60 + rank) AS part FROM dense UNION ALL SELECT query_id, id, {sparse} :: DOUBLE / (60 + rank) FROM sparse WHERE rank <= 30) GROUP BY query_id, id)) WHERE rank <= {most}"""


# ---------------------------------------------------------------- dense


@query(dense_sql(10))
def dense_topk(load, spark):
    """L2, G7."""
    return search.dense(points(load), vector_queries(load), 10)


@query(dense_sql(10, "dot"))
def dot_topk(load, spark):
    """L3."""
    return search.dense(points(load), vector_queries(load), 10, "dot")


@query(dense_sql(10, "euclid"))
def euclid_topk(load, spark):
    """L3."""
    return search.dense(points(load), vector_queries(load), 10, "euclid")


@query(dense_sql(10, "manhattan"))
def manhattan_topk(load, spark):
    """L3."""
    return search.dense(points(load), vector_queries(load), 10, "manhattan")


@query(dense_sql(10, where="label IN (1, 2, 3)"))
def filtered_dense_topk(load, spark):
    """The filter stays below the join and reaches the scan."""
    return search.dense(points(load).filter(F.col("label").isin(1, 2, 3)), vector_queries(load), 10)


@query(dense_sql(5, where="label = 4"))
def quality_filter_topk(load, spark):
    """Points of one quality only."""
    return search.dense(points(load).filter("label = 4"), vector_queries(load), 5)


@query(dense_sql(3, queries=ITEM_VECTORS))
def batch_knn(load, spark):
    """Nearest points of many queries in one plan."""
    return search.dense(points(load), item_vectors(load), 3)


@query(dense_sql(3, by=", label", columns=", label"))
def topk_per_group(load, spark):
    """The best three of each collection."""
    return search.dense_by(points(load), vector_queries(load), 3, "label").select("query_id", "id", "score", "rank", "label")


RAG5 = f"""SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) :: INT AS rank FROM ({dense_sql(3, by=", label", columns=", label")})) WHERE rank <= 5"""


@query(RAG5)
def rag_top5(load, spark):
    """The best three of each collection, and of those the best five."""
    hits = topk_per_group(load, spark)
    return search.best(hits.drop("rank"), 5, "query_id").select("query_id", "id", "score", "rank")


@query(f"SELECT query_id, id, score FROM ({dense_sql(50)})")
def initial_candidates(load, spark):
    """K2: the first fifty by score of every stated query."""
    return search.dense(points(load), vector_queries(load), 50).select("query_id", "id", "score")


@query(f"SELECT query_id, vec_id AS id, round({METRIC['cosine']}, 6) AS score FROM (SELECT vec_id, embedding AS v FROM embeddings), ({QUERY_VECTORS})")
def cosine_similarity(load, spark):
    """L1: a stated set of queries against all points."""
    return search.similarities(points(load), vector_queries(load))


@query(dense_sql(10, where="vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND length(text) // 4 >= 100)"))
def advanced_filtered_search(load, spark):
    """Nearest points among those whose payload passes a composed filter."""
    payload = load("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.floor(F.length("text") / 4).alias("complexity"))
    fit = payload.filter(search.filters(language="en", complexity=100)).select("id")
    return search.dense(points(load).join(fit, "id", "left_semi"), vector_queries(load), 10)


# ---------------------------------------------------------------- sparse and hybrid


@query(f"WITH {BM25_OWN} SELECT term, df FROM idf")
def bm25_df(load, spark):
    """H5."""
    return search.document_frequency(search.counted(texts(load)))


@query(f"WITH {BM25_OWN} SELECT n AS n_docs, (SELECT sum(len(t)) :: BIGINT FROM d) AS total_length, round(avgdl, 6) AS avgdl FROM stats")
def bm25_corpus_stats(load, spark):
    """H6."""
    return search.corpus_stats(search.counted(texts(load))).select("n_docs", "total_length", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM25_OWN} SELECT id, term, tf FROM tf")
def bm25_tf(load, spark):
    """H7."""
    return search.postings(search.counted(texts(load))).select("id", "term", "tf")


@query(f"WITH {BM25_OWN} SELECT term, round(idf, 6) AS idf FROM idf")
def bm25_idf(load, spark):
    """M1-M3."""
    return search.idf_table(indexed(load)).select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25_OWN} SELECT id, term, round(w, 6) AS w FROM w")
def bm25_weights(load, spark):
    """M4, M12."""
    return search.weights(indexed(load)).select("id", "term", F.round("w", 6).alias("w"))


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM sparse WHERE rank <= 10")
def sparse_topk(load, spark):
    """Both sides weighed."""
    return inverted.top(inverted_index(load), text_queries(load), 10)


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM classic WHERE rank <= 10")
def bm25_topk(load, spark):
    """M5: the classic score."""
    return inverted.top(inverted_index(load), text_queries(load), 10, weighed=False)


@query(f"""WITH {BM25}, slabs AS (SELECT query_id, term, count(*) AS n FROM tf JOIN asked USING (term) GROUP BY query_id, term)
SELECT query_id, count(*) AS terms, sum(n) :: BIGINT AS postings FROM slabs GROUP BY query_id""")
def postings_of_queries(load, spark):
    """M5: for each query, how many of its terms the stored index has, and how many postings they have."""
    index = inverted_index(load)
    mine = inverted.asked(index, text_queries(load))
    blocks = index.blocks.select("term", "n").filter(mine.at_scan).join(mine.send(mine.terms), "term")
    return blocks.groupBy("query_id").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("postings"))


@query(f"""WITH {BM25_OWN} SELECT id, count(*) AS terms, sum(tf) :: BIGINT AS length, round(sum(w), 4) AS total FROM w JOIN tf USING (id, term) GROUP BY id""")
def bm25_document_weights(load, spark):
    """Of each document, its encoded terms, their occurrences and the sum of their weights."""
    index = inverted_index(load)
    rows = inverted.postings(index.blocks.join(index.terms, "term"), "idf", "avgdl")
    w = search.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))
    return rows.groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("length"), F.round(F.sum(w), 4).alias("total"))


def legs(load):
    return search.dense(points(load), item_vectors(load), 50), inverted.top(inverted_index(load), text_queries(load), 30)


@query(f"WITH {LEGS} {fused_sql(1, 1)}")
def hybrid_rrf(load, spark):
    """M7, G9."""
    dense, sparse = legs(load)
    return search.fused([(dense, 1), (sparse, 1)], 10)


@query(f"WITH {LEGS} {fused_sql(0.7, 0.3)}")
def weighted_rrf(load, spark):
    """M8."""
    dense, sparse = legs(load)
    return search.fused([(dense, 0.7), (sparse, 0.3)], 10)


@query(f"""WITH {LEGS}, joined AS (SELECT query_id, id, score, 'vector' AS leg FROM dense WHERE rank <= 10 UNION ALL
SELECT query_id, id, score, 'keyword' FROM sparse s WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM dense d WHERE d.rank <= 10 AND d.query_id = s.query_id AND d.id = s.id))
SELECT query_id, id, score, leg, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) :: INT AS rank FROM joined) WHERE rank <= 10""")
def union_dedup_search(load, spark):
    """Vector hits, and keyword hits with other ids."""
    dense, sparse = legs(load)
    vector = dense.filter("rank <= 10").drop("rank").withColumn("leg", F.lit("vector"))
    keyword = sparse.filter("rank <= 10").drop("rank").withColumn("leg", F.lit("keyword"))
    both = vector.unionByName(keyword.join(vector.select("query_id", "id"), ["query_id", "id"], "left_anti"))
    return search.best(both, 10, "query_id").select("query_id", "id", "score", "leg", "rank")


@query(f"""WITH {LEGS}, a AS (SELECT query_id, id FROM dense WHERE rank <= 10), b AS (SELECT query_id, id FROM sparse WHERE rank <= 10)
SELECT query_id, count(*) FILTER (x AND y) AS in_both, count(*) FILTER (x AND NOT y) AS only_dense, count(*) FILTER (y AND NOT x) AS only_sparse,
round(100.0 * count(*) FILTER (x AND y) / count(*), 6) AS overlap FROM (SELECT query_id, a.id IS NOT NULL AS x, b.id IS NOT NULL AS y FROM a FULL JOIN b USING (query_id, id)) GROUP BY query_id""")
def compare_methods(load, spark):
    """What two methods find in common."""
    dense, sparse = legs(load)
    hits = dense.filter("rank <= 10").select("query_id", "id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(sparse.filter("rank <= 10").select("query_id", "id", F.lit(0).alias("x"), F.lit(1).alias("y")))
    each = hits.groupBy("query_id", "id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    both = F.count_if((F.col("x") == 1) & (F.col("y") == 1))
    return each.groupBy("query_id").agg(
        both.alias("in_both"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("only_dense"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("only_sparse"), F.round(F.lit(100.0) * both / F.count("*"), 6).alias("overlap")
    )


# ---------------------------------------------------------------- reranking

SPLIT = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda t: t <> '')"
CANDIDATES = f"""{BM25}, hits AS (SELECT query_id, id FROM sparse WHERE rank <= 50),
pairs AS (SELECT query_id, id, list_distinct({SPLIT.format('b.text')}) AS a, {SPLIT.format('d.text')} AS o FROM hits JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id),
relevance AS (SELECT query_id, id, round(CASE WHEN len(a) = 0 OR len(o) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.6 :: DOUBLE * (len(list_intersect(a, list_distinct(o))) / len(a)) + 0.4 :: DOUBLE * (len(list_filter(o, lambda t: list_contains(a, t))) / len(o)))) END, 6) AS relevance FROM pairs)"""
SCORED = f"""{CANDIDATES}, semantic AS (SELECT r.query_id, r.id, relevance, round(coalesce(list_cosine_similarity(x.embedding :: DOUBLE[], y.embedding :: DOUBLE[]), 0.0), 6) AS semantic
FROM relevance r LEFT JOIN embeddings x ON x.vec_id = r.query_id LEFT JOIN embeddings y ON y.vec_id = r.id),
fused AS (SELECT *, round(0.6 :: DOUBLE * semantic + 0.3 :: DOUBLE * relevance, 8) AS score FROM semantic)"""


def candidates(load):
    """(query_id, id, relevance) of the first fifty by the sparse leg."""
    pairs = stored(inverted.top(inverted_index(load), text_queries(load), 50).select("query_id", "id"), "candidates")
    return rerank.relevances(pairs, text_queries(load), texts(load))


def with_semantic(hits, load):
    """hits with the cosine of the query's and the point's vectors; hits are few and are sent to the vectors."""
    vectors = load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("own"))
    asked = load("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    own = stored(hits, "hits")
    few = F.broadcast if own.count() <= search.SENT else lambda df: df
    ours = vectors.join(few(own.select("id").distinct()), "id", "left_semi")
    theirs = asked.join(few(own.select("query_id").distinct()), "query_id", "left_semi")
    both = own.join(ours, "id", "left").join(theirs, "query_id", "left")
    return both.withColumn("semantic", F.round(F.coalesce(V.cosine(F.col("asked"), F.col("own")), F.lit(0.0)), 6)).drop("own", "asked")


@query(f"WITH {CANDIDATES} SELECT query_id, id, relevance FROM relevance")
def relevance_score(load, spark):
    """N2."""
    return candidates(load)


@query(f"WITH {SCORED} SELECT query_id, id, semantic, relevance, score FROM fused")
def score_fusion(load, spark):
    """N3, N4."""
    hits = with_semantic(candidates(load), load)
    return hits.select("query_id", "id", "semantic", "relevance", F.round(rerank.fusion(vector=F.col("semantic"), keyword=F.col("relevance")), 8).alias("score"))


@query(f"WITH {SCORED} SELECT query_id, id, round((relevance + semantic) / 2, 8) AS quality FROM fused WHERE (relevance + semantic) / 2 >= 0.1")
def qa_threshold(load, spark):
    """D11, N5."""
    hits = with_semantic(candidates(load), load)
    score = (F.col("relevance") + F.col("semantic")) / 2
    return hits.filter(rerank.assured(score)).select("query_id", "id", F.round(score, 8).alias("quality"))


@query(f"""WITH {SCORED} SELECT query_id, id, relevance, semantic, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) :: INT AS rank FROM fused
WHERE (relevance + semantic) / 2 >= 0.1) WHERE rank <= 10""")
def rerank_pipeline(load, spark):
    """Candidates, both scores, fusion, quality filter and cut in one plan."""
    found = rerank.reranked(with_semantic(candidates(load), load))
    return found.filter("rank <= 10").select("query_id", "id", "relevance", "semantic", "score", "rank")


# ---------------------------------------------------------------- embedding quality

MOMENTS = """m AS (SELECT vec_id, embedding :: DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, len(v) AS n, list_avg(v) AS mean, list_sum(list_transform(v, lambda x: x * x)) AS sq FROM m),
o AS (SELECT *, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / n AS variance, list_transform(v, lambda x: abs(x) + 1e-8) AS p FROM n),
r AS (SELECT *, sqrt(sq) AS norm, list_sum(list_transform(v, lambda x: (x - mean) ** 3)) / n / variance ** 1.5 AS skewness, list_sum(list_transform(v, lambda x: (x - mean) ** 4)) / n / variance ** 2 - 3 AS kurtosis,
ln(list_sum(p)) - list_sum(list_transform(p, lambda x: x * ln(x))) / list_sum(p) AS entropy FROM o)"""


@query(f"""WITH {MOMENTS} SELECT vec_id, round(norm, 6) AS norm, round(mean, 6) AS mean, round(sqrt(variance), 6) AS std, round(list_min(v), 6) AS least, round(list_max(v), 6) AS most, round(variance, 6) AS variance,
round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(entropy, 6) AS entropy, round(len(list_filter(v, lambda x: abs(x) < 1e-6)) / n, 6) AS sparsity, round(len(list_filter(v, lambda x: x > 0)) / n, 6) AS positive FROM r""")
def vector_moments(load, spark):
    """H12."""
    v = F.col("v")
    found = {
        "norm": F.col("norm"),
        "mean": F.col("mean"),
        "std": F.sqrt("variance"),
        "least": F.array_min(v),
        "most": F.array_max(v),
        "variance": F.col("variance"),
        "skewness": validate.skewness(),
        "kurtosis": validate.kurtosis(),
        "entropy": F.col("entropy"),
        "sparsity": V.share(v, lambda x: F.abs(x) < 1e-6),
        "positive": V.share(v, lambda x: x > 0),
    }
    # computed under other names first: within lambdas a name means the new column of that name
    raw = validate.ready(load("embeddings")).select("vec_id", *[c.alias(f"raw_{k}") for k, c in found.items()])
    return raw.select("vec_id", *[F.round(f"raw_{k}", 6).alias(k) for k in found])


@query("""SELECT vec_id, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75,
round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM (SELECT vec_id, unnest(embedding) :: DOUBLE AS x FROM embeddings) GROUP BY vec_id""")
def vector_percentiles(load, spark):
    """H13."""
    df = load("embeddings").select("vec_id", F.array_sort(V.doubles(F.col("embedding"))).alias("s"))
    at = {f"p{int(q * 100)}": V.quantile(F.col("s"), q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    return df.select("vec_id", *[F.round(c, 6).alias(name) for name, c in at.items()], F.round(at["p75"] - at["p25"], 6).alias("iqr"))


@query("""SELECT vec_id, round(corr(x, y), 6) AS autocorrelation FROM (SELECT vec_id, unnest(list_slice(embedding, 1, len(embedding) - 1)) :: DOUBLE AS x, unnest(list_slice(embedding, 2, len(embedding))) :: DOUBLE AS y FROM embeddings) GROUP BY vec_id""")
def vector_autocorr(load, spark):
    """H14, J4."""
    v = V.doubles(F.col("embedding"))
    df = load("embeddings").select("vec_id", F.slice(v, F.lit(1), F.size("embedding") - 1).alias("x"), F.slice(v, F.lit(2), F.size("embedding") - 1).alias("y"))
    return df.select("vec_id", F.round(V.correlation(F.col("x"), F.col("y")), 6).alias("autocorrelation"))


@query("""SELECT vec_id, round(avg(variance), 6) AS local_mean, round(stddev_pop(variance), 6) AS local_std FROM (SELECT vec_id, i, var_pop(x) AS variance FROM
(SELECT vec_id, i, unnest(list_slice(embedding, i, i + 49)) :: DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) - 48, 25)) AS i FROM embeddings)) GROUP BY vec_id, i) GROUP BY vec_id""")
def local_variance(load, spark):
    """H15."""
    v = V.doubles(F.col("embedding"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("embedding") - 49, F.lit(1)), F.lit(25))
    df = load("embeddings").select("vec_id", F.transform(starts, lambda i: F.slice(v, i, 50)).alias("w"))
    df = df.select("vec_id", F.transform("w", lambda w: V.moment(w, V.mean(w), 2)).alias("s"))
    return df.select("vec_id", F.round(V.mean(F.col("s")), 6).alias("local_mean"), F.round(F.sqrt(V.moment(F.col("s"), V.mean(F.col("s")), 2)), 6).alias("local_std"))


@query(f"""WITH {MOMENTS} SELECT vec_id, CASE WHEN n = 0 THEN 'Empty embedding' WHEN n <> 64 THEN 'Wrong dimension' WHEN norm < 0.1 THEN 'Embedding magnitude too low' WHEN norm > 1000 THEN 'Embedding magnitude too high'
WHEN variance < 1e-4 THEN 'Embedding variance too low' ELSE 'Valid embedding' END AS message FROM r""")
def embedding_gate(load, spark):
    """O2, O3, D12."""
    return validate.ready(load("embeddings")).select("vec_id", validate.gate(64).alias("message"))


@query(f"""WITH {MOMENTS} SELECT vec_id, n = 64 AS dimension_match, true AS is_finite, len(list_filter(v, lambda x: abs(x) > 1e-8)) > 0 AS not_zero_vector, sqrt(variance) > 1e-8 AS not_constant_vector,
norm > 0.01 AND norm < 1000 AS reasonable_magnitude FROM r""")
def validate_dimensionality(load, spark):
    """O5."""
    return validate.ready(load("embeddings")).select("vec_id", *[c.alias(k) for k, c in validate.dimensionality(64).items()])


DISTRIBUTION = f"""WITH {MOMENTS}, q AS (SELECT vec_id, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM (SELECT vec_id, unnest(v) AS x FROM m) GROUP BY vec_id)
SELECT vec_id, n >= 64 AS sufficient_dimensions, len(list_filter(v, lambda x: abs((x - mean) / sqrt(variance)) > 3)) / n * 100 < 5 AS no_excessive_outliers, iqr > 1e-6 AS balanced_distribution,
abs(skewness) < 7 AS reasonable_skewness, abs(kurtosis) < 7 AS reasonable_kurtosis FROM r JOIN q USING (vec_id)"""


@query(DISTRIBUTION)
def validate_distribution(load, spark):
    """O7."""
    return validate.ready(load("embeddings")).select("vec_id", *[c.alias(k) for k, c in validate.distribution(64).items()])


CONSISTENCY = f"""WITH {MOMENTS}, s AS (SELECT vec_id, list_transform(range(1, len(v)), lambda i: abs(v[i + 1] - v[i])) AS d FROM m),
w AS (SELECT vec_id, bool_or(same) AS repeats FROM (SELECT vec_id, len(list_filter(range(0, 10), lambda k: abs(v[i + k] - v[i + 10 + k]) > 1e-8 + 0.01 * abs(v[i + 10 + k]))) = 0 AS same FROM (SELECT vec_id, v, unnest(range(1, len(v) - 19)) AS i FROM m)) GROUP BY vec_id)
SELECT vec_id, NOT repeats AS no_repeating_patterns, variance > 1e-6 AS sufficient_variance, list_max(list_transform(v, lambda x: abs(x))) <= 100 AS no_extreme_values, list_max(d) < 50 * list_avg(d) AS smooth_distribution
FROM r JOIN s USING (vec_id) JOIN w USING (vec_id)"""


@query(CONSISTENCY)
def validate_consistency(load, spark):
    """O10, J5."""
    return validate.ready(load("embeddings")).select("vec_id", *[c.alias(k) for k, c in validate.consistency().items()])


# ---------------------------------------------------------------- validators that need code beside the vector

CODE = f"""code AS (SELECT doc_id, text, lang, {worded('def class function if else elif for while try except finally import from')} + len(regexp_extract_all(text, '@[\\p{{L}}\\p{{N}}_]+'))
+ {counted(['='])} - ({counted(['=='])}) - ({counted(['!='])}) + {counted(['(', '{', '['])} AS syntax, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS tokens FROM documents)"""


def described(load):
    """Vectors with the text of the same number."""
    docs = load("documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("code"), F.col("lang").alias("language"))
    return validate.ready(load("embeddings").join(docs, "vec_id"))


@query(f"""WITH {MOMENTS}, {CODE} SELECT vec_id, tokens > 0 AND variance / greatest(tokens, 1) > 1e-6 AND variance / greatest(tokens, 1) * entropy > 1e-6 AND variance * 1000 / greatest(syntax, 1) > 0.01
AND variance * 1000 / greatest(syntax, 1) < 100 AND variance > 1e-8 AS passed FROM r JOIN code ON doc_id = vec_id""")
def validate_semantic(load, spark):
    """O6."""
    tokens = T.token_count(F.col("code"))
    return described(load).select("vec_id", ((tokens > 0) & validate.semantic(T.syntax_complexity(F.col("code")), tokens)).alias("passed"))


@query(f"""WITH {MOMENTS}, {CODE}, f AS (SELECT doc_id, contains(text, 'import ') :: INT + contains(text, 'from ') :: INT AS hints, {worded('if for while def class')} AS branches FROM documents),
a AS (SELECT vec_id, v, n, variance, entropy, hints, branches, CASE WHEN hints + branches = 0 THEN NULL ELSE variance * entropy * 1000 / (hints + branches) END AS ratio FROM r JOIN f ON doc_id = vec_id)
SELECT vec_id, round(CASE WHEN ratio IS NULL THEN 0.0 WHEN ratio < 0.1 THEN ratio / 0.1 WHEN ratio > 10 THEN 10 / ratio ELSE 1.0 END, 6) AS alignment,
hints > 0 AND variance > 1e-6 AND entropy > 0.1 AND len(list_filter(v, lambda x: x > 0)) / n > 0.3 AND len(list_filter(v, lambda x: x > 0)) / n < 1 AND
coalesce(CASE WHEN ratio < 0.1 THEN ratio / 0.1 WHEN ratio > 10 THEN 10 / ratio ELSE 1.0 END, 0.0) > 0.3 AND ratio IS NOT NULL AS passed FROM a""")
def validate_domain(load, spark):
    """How the vector's complexity stands to the code's."""
    code = F.col("code")
    hints = code.contains("import ").cast("int") + code.contains("from ").cast("int")
    branches = F.regexp_count(code, F.lit(r"(?U)\bif\b|\bfor\b|\bwhile\b|\bdef\b|\bclass\b"))
    rows = described(load).withColumn("hints", hints).withColumn("branches", branches)
    aligned = validate.alignment(F.col("hints"), F.col("branches"))
    return rows.select("vec_id", F.round(aligned, 6).alias("alignment"), validate.domain(F.col("hints"), F.col("branches"), F.lit(True)).alias("passed"))


@query(f"""SELECT id, len(dependencies) = 0 OR len(list_intersect(dependencies, regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*'))) > 0 AS passed FROM {CHUNKS_SQL}""")
def validate_dependency(load, spark):
    """Something declared is found in the code, or nothing is declared."""
    names = F.regexp_extract_all("code", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return chunks(load).select("id", validate.dependency(F.col("dependencies"), names).alias("passed"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 AND l_quantity >= 10")
def payload_range(load, spark):
    """Ranges over integer payload fields, pushed into the scan."""
    return load("lineitem").filter(F.col("l_linenumber").between(2, 4) & (F.col("l_quantity") >= 10)).select("l_orderkey", "l_linenumber")


@query(f"""WITH c AS (SELECT * FROM {CHUNKS_SQL}) SELECT t.id AS test_id, c.id FROM c t JOIN c ON list_contains(t.dependencies, c.name) WHERE contains(t.file_path, 'test')""")
def related_tests(load, spark):
    """P10: tests and the chunks that they depend on, by name."""
    c = chunks(load)
    tests = c.filter(F.col("file_path").contains("test")).select(F.col("id").alias("test_id"), F.explode("dependencies").alias("name"))
    return tests.join(c.select("id", "name"), "name").select("test_id", "id")


REPORT = f"""WITH {MOMENTS}, {CODE}, dist AS ({DISTRIBUTION}), cons AS ({CONSISTENCY}), f AS (SELECT doc_id, text AS code, doc_id % 3 = 0 AS bare, contains(text, 'import ') :: INT + contains(text, 'from ') :: INT AS hints, {worded('if for while def class')} AS branches FROM documents),
a AS (SELECT r.*, syntax, tokens, hints, branches, bare, len(list_filter(v, lambda x: x > 0)) / n AS positive, variance * entropy AS complex, CASE WHEN hints + branches = 0 THEN 0.0 WHEN variance * entropy * 1000 / (hints + branches) < 0.1 THEN variance * entropy * 10000 / (hints + branches)
WHEN variance * entropy * 1000 / (hints + branches) > 10 THEN 10 / (variance * entropy * 1000 / (hints + branches)) ELSE 1.0 END AS aligned, variance / greatest(tokens, 1) AS density, variance * 1000 / greatest(syntax, 1) AS ratio, len({DETECTED}) > 0 AS shows
FROM r JOIN code ON code.doc_id = vec_id JOIN f ON f.doc_id = vec_id),
ok AS (SELECT vec_id, hints, aligned, density, ratio, n = 64 AND norm > 0.01 AND norm < 1000 AS d1, tokens > 0 AND density > 1e-6 AND density * entropy > 1e-6 AND ratio > 0.01 AND ratio < 100 AND variance > 1e-8 AS d2,
sufficient_dimensions AND no_excessive_outliers AND balanced_distribution AND reasonable_skewness AND reasonable_kurtosis AS d3, no_excessive_outliers, hints > 0 AND variance > 1e-6 AND entropy > 0.1 AND positive > 0.3 AND positive < 1 AND aligned > 0.3 AS d4,
no_repeating_patterns AND sufficient_variance AND no_extreme_values AND smooth_distribution AS d5, bare OR (shows AND complex > 1e-6) AS d6 FROM a JOIN dist USING (vec_id) JOIN cons USING (vec_id)),
said AS (SELECT *, list_filter([CASE WHEN NOT d2 AND density < 1e-6 THEN 'Low semantic density - consider including more context in embedding_text' END, CASE WHEN NOT d2 AND ratio < 0.01 THEN 'Embedding complexity too low for code complexity - model may not capture code structure' END,
CASE WHEN NOT d3 AND NOT no_excessive_outliers THEN 'High outlier percentage detected - embedding may be unstable' END, CASE WHEN NOT d4 AND hints = 0 THEN 'No code elements detected - ensure chunk contains actual code' END,
CASE WHEN NOT d4 AND NOT aligned > 0.3 THEN 'Poor alignment between code and embedding - model may not understand code structure' END, CASE WHEN NOT d5 THEN 'Consistency issues detected - verify model stability across batches' END,
CASE WHEN NOT d6 THEN 'Dependencies not well represented - ensure dependency metadata is included in embedding_text' END], lambda x: x IS NOT NULL) AS found FROM ok)
SELECT vec_id, round(0.25 * d1 :: INT + 0.25 * d2 :: INT + 0.15 * d3 :: INT + 0.15 * d4 :: INT + 0.1 * d5 :: INT + 0.1 * d6 :: INT, 6) :: DOUBLE AS overall, d1 AND d2 AND d3 AND d4 AND d5 AND d6 AS passed,
list_filter([CASE WHEN NOT d1 THEN 'dimensionality' END, CASE WHEN NOT d2 THEN 'semantic' END, CASE WHEN NOT d3 THEN 'distribution' END, CASE WHEN NOT d4 THEN 'domain' END, CASE WHEN NOT d5 THEN 'consistency' END, CASE WHEN NOT d6 THEN 'dependency' END], lambda x: x IS NOT NULL) AS failed,
CASE WHEN len(found) = 0 THEN ['All validations passed - embedding quality is good'] ELSE found END AS recommendations FROM said"""


def reported(load):
    """Vectors with the texts of the same number, scored by all six validators; some declare their language as a dependency."""
    declared = F.when(F.col("vec_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("language"))
    rows = described(load).withColumn("declared", declared).withColumn("detected", T.detected_dependencies(F.col("code")))
    heads = F.filter("rejection_reasons", lambda r: ~r.startswith(" "))
    return validate.report(rows).withColumn("failed", F.transform(heads, lambda r: F.regexp_extract(r, "^([a-z]+)_", 1)))


@query(f"SELECT vec_id, overall, passed, failed AS reasons FROM ({REPORT})")
def quality_overall(load, spark):
    """The profile's score of all six validators, and which of them failed."""
    return reported(load).select("vec_id", "overall", "passed", F.col("failed").alias("reasons"))


@query(REPORT)
def quality_report(load, spark):
    """The same with recommendations."""
    return reported(load).select("vec_id", "overall", "passed", "failed", "recommendations")


CELLS, RECALL = 16, 0.95


@query()
def ann_topk(load, spark):
    """Nearest points from the cells of the nearest centroids; tests hold it against exact search."""
    sample = ann.sampled(points(load))
    centers = ann.fitted(sample, CELLS)
    probes = ann.probes_for(sample, centers, RECALL)
    return search.best(ann.nearest(ann.index(points(load), centers), centers, vector_queries(load), 10, probes), 10, "query_id").select("query_id", "id", "score", "rank")


@query()
def quantised_topk(load, spark):
    """Nearest points from compressed vectors in cells, scored exactly at the end; tests hold it against exact search."""
    index = quantised.build(points(load), new_folder(spark, "quantised"))
    return quantised.nearest(index, vector_queries(load), 10)
