"""Reranking: term overlap, score fusion, the quality filter, and all of it as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import search

# Weights of the fused scores.
WEIGHTS = {"vector": 0.6, "keyword": 0.3, "metadata": 0.1}


def relevances(pairs: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, id, relevance) of stored pairs (query_id, id): 0.6 * share of the query's terms that the
    text has + 0.4 * share of its tokens that are query terms; 0 where either has none.

    queries (query_id, text) and pairs are few and are sent to the texts (id, text), of which only the
    candidates are split, each once.
    """
    few = F.broadcast if pairs.count() <= search.SENT else lambda df: df
    own = texts.join(few(pairs.select("id").distinct()), "id", "left_semi")
    own = own.select("id", T.let(F.sort_array(T.split_terms(F.col("text"))), lambda w: F.struct(F.size(w).alias("n"), T.run_lengths(w).alias("terms"))).alias("w"))
    rows = own.select("id", F.col("w.n").alias("n"), F.explode("w.terms").alias("t")).select("id", "n", "t.term", "t.tf")
    asked = queries.select("query_id", F.array_distinct(T.split_terms(F.col("text"))).alias("terms"))
    asked = asked.select("query_id", F.size("terms").alias("m"), F.explode("terms").alias("term"))
    met = rows.join(few(pairs), "id").join(search.small(asked), ["query_id", "term"]).groupBy("query_id", "id")
    found = met.agg(F.count("*").alias("found"), F.sum("tf").alias("dense"), F.max("n").alias("n"), F.max("m").alias("m"))
    value = F.lit(0.6) * (F.col("found") / F.col("m")) + F.lit(0.4) * (F.col("dense") / F.col("n"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))
    return pairs.join(found, ["query_id", "id"], "left").select("query_id", "id", F.round(score, 6).alias("relevance"))


def fusion(weights: dict[str, float] = WEIGHTS, **scores: Column) -> Column:
    """The weighted sum of scores; weights are made to add up to 1, a missing score counts 0."""
    total = sum(weights.values())
    total = 1.0 if abs(total - 1) < 1e-9 else total
    return sum((F.lit(w / total) * F.coalesce(scores.get(name, F.lit(None).cast("double")), F.lit(0.0)) for name, w in weights.items()), F.lit(0.0))


def assured(score: Column, least: float = 0.1) -> Column:
    return score >= least


def reranked(hits: DataFrame, least: float = 0.1) -> DataFrame:
    """hits (query_id, id, relevance, semantic) with fused score and rank; weak ones go."""
    scored = hits.withColumn("score", F.round(fusion(vector=F.col("semantic"), keyword=F.col("relevance")), 8))
    good = scored.filter(assured((F.col("relevance") + F.col("semantic")) / 2, least))
    return good.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
