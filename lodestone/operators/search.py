"""Dense, sparse and hybrid search; every query of a batch is ranked apart.

Texts are split into words once, into an index with one row for each document (index()); statistics,
frequencies and matches are read from its columns.  A document's terms are counted within its row, so
building the index shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import nearest
from lodestone.operators.tables import stored

DIGITS = nearest.DIGITS
SENT = 1_000_000  # rows that are broadcast at most


def small(df: DataFrame, most: int = SENT) -> DataFrame:
    """A stored table, marked for broadcast while it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def best(hits: DataFrame, most: int, *by: str, score: str = "score", descending: bool = True, key: str = "id") -> DataFrame:
    """The best rows of each group, with their rank; Spark keeps only so many of a group in each task."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).filter(F.col("rank") <= most)


def dense(points: DataFrame, queries: DataFrame, most: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank): exact nearest points (id, vector) of queries (query_id, query).

    Filters on points stay below; see nearest.py.
    """
    hits = nearest.nearest(points, queries, most, metric)
    return best(hits, most, "query_id", descending=nearest.METRICS[metric][1])


def dense_by(points: DataFrame, queries: DataFrame, most: int, group: str, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score, group, rank): the nearest points of each group."""
    hits = nearest.nearest(points, queries, most, metric, group)
    return best(hits, most, "query_id", group, descending=nearest.METRICS[metric][1])


def similarities(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): the cosine of every point and each query of a stated set, in blocks, as matrix products."""
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    many, dim = asked.agg(F.count("*"), F.max(F.size("query"))).first()
    parts = max(1, -(-many // max(1, min(nearest.MOST_QUERIES, nearest.MOST_BYTES // (8 * max(1, dim or 1))))))
    out = None
    for k in range(parts):
        some = (asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)).toArrow()
        if some.num_rows or parts == 1:
            found = nearest.cosines(points, some)
            out = found if out is None else out.unionByName(found)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(id, dl, terms): each document's length in words, and its different terms with how often they stand."""
    words = T.let(F.sort_array(T.terms(F.col("text"))), lambda w: F.struct(F.size(w).alias("dl"), T.run_lengths(w).alias("terms")))
    return docs.select("id", words.alias("w")).select("id", F.coalesce("w.dl", F.lit(0)).alias("dl"), F.coalesce("w.terms", F.array().cast("array<struct<term:string,tf:int>>")).alias("terms"))


def index(docs: DataFrame) -> DataFrame:
    """counted(), written once."""
    return stored(counted(docs), "index")


def postings(own: DataFrame) -> DataFrame:
    """(id, dl, term, tf) of an index."""
    return own.select("id", "dl", F.explode("terms").alias("t")).select("id", "dl", "t.term", F.col("t.tf").cast("long").alias("tf"))


def corpus_stats(own: DataFrame) -> DataFrame:
    """One row: n_docs, total_length, avgdl; reads the lengths only."""
    return own.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_length"), F.avg("dl").alias("avgdl"))


def document_frequency(own: DataFrame) -> DataFrame:
    """(term, df)."""
    return own.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def weight(tf: Column, dl: Column, avgdl: Column, rarity: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return rarity * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def rated(frequencies: DataFrame, own: DataFrame) -> DataFrame:
    """(term, df, idf, avgdl) of terms (term, df), with the one row of corpus statistics beside each."""
    stats = corpus_stats(own).select("n_docs", "avgdl")
    return frequencies.join(F.broadcast(stats)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")


def idf_table(own: DataFrame) -> DataFrame:
    """(term, df, idf, avgdl): the whole vocabulary of an index."""
    return rated(document_frequency(own), own)


def weights(own: DataFrame) -> DataFrame:
    """(id, term, w): BM25 weights of all postings of an index.

    Terms in more than a thousandth of the documents, of which there are at most a thousand times as
    many as a document has on average, are broadcast and their postings stay where they are; only
    the postings of other terms are dealt by term, so no hot term is.
    """
    vocabulary = stored(idf_table(own), "vocabulary")
    bar = max(1, own.count() // 1000)
    frequent = F.broadcast(vocabulary.filter(F.col("df") > bar))
    rows = postings(own)
    weighed = weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))
    near = rows.join(frequent, "term").select("id", "term", weighed.alias("w"))
    rare = rows.join(frequent.select("term"), "term", "left_anti").join(vocabulary.filter(F.col("df") <= bar), "term")
    return near.unionByName(rare.select("id", "term", weighed.alias("w")))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, dl, term, tf) of queries (query_id, text), written once."""
    return stored(postings(counted(queries.select(F.col("query_id").alias("id"), "text"))).withColumnRenamed("id", "query_id"), "asked")


def matched(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, query_id, w, q): for each term that a query and a document share, their weights.

    The terms asked for are counted once and broadcast, and meet the postings before anything is grouped
    or moved; their frequencies are read from the same few postings.
    """
    few = F.broadcast if asked.count() <= SENT else lambda df: df  # all below have no more rows than asked
    wanted = few(asked.select("term").distinct())
    found = own.select(F.explode("terms.term").alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    mine = asked.join(rated(found, own), "term").select("query_id", "term", "idf", "avgdl", weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf")).alias("q"))
    return postings(own).join(few(mine), "term").select("id", "query_id", weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf")).alias("w"), "q")


def sparse(own: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score, rank): documents of an index by the product of BM25 weights with queries (query_id, text)."""
    scores = matched(own, asked_terms(queries)).groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("q")), DIGITS).alias("score"))
    return best(scores, most, "query_id")


def bm25(own: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score, rank) by the classic sum of the documents' weights."""
    scores = matched(own, asked_terms(queries)).groupBy("query_id", "id").agg(F.round(F.sum("w"), DIGITS).alias("score"))
    return best(scores, most, "query_id")


def fused(legs: list[tuple[DataFrame, float]], most: int, k: int = 60) -> DataFrame:
    """(query_id, id, score, rank): weighted reciprocal rank fusion of ranked legs."""
    parts = None
    for leg, share in legs:
        one = leg.select("query_id", "id", (F.lit(float(share)) / (F.lit(k) + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    scores = parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return best(scores, most, "query_id")


def prefetch(points: int, limit: int, wanted: int) -> int:
    """How many candidates each leg fetches, by the number of points."""
    if points < 1000:
        return min(wanted, points)
    if points < 10000:
        return min(wanted, max(4 * limit, 100))
    return min(wanted, max(5 * limit, 200))


def batch_size(points: int) -> int:
    """How many points an upload takes at once."""
    return 50 if points < 100 else 100 if points < 1000 else 200


def filters(language: str | None = None, kind: str | None = None, complexity: int | None = None, path: str | None = None, like: str | None = None) -> Column:
    """The conjunction of the filters given."""
    out = F.lit(True)
    if language is not None:
        out = out & (F.col("language") == language)
    if kind is not None:
        out = out & (F.col("type") == kind)
    if complexity is not None:
        out = out & (F.col("complexity") >= complexity)
    if path is not None:
        out = out & (F.col("file_path") == path)
    if like is not None:
        out = out & F.col("file_path").like(like)
    return out
