"""Ranking beyond fusion: learning to rank, diversity, boosts, windows, and how good a ranking is.

Hits are rows (query_id, id, score, ...), a bounded list for each query (search.best), so a query's list
may be handled in one place; the number of queries may be any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.operators.nearest import matrix, rounded
from lodestone.operators.tables import stored

# ---------------------------------------------------------------- learning to rank


def pair_moments(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """One row: n, the ordered pairs of hits of one query with different labels; b_i and a_i_j, the sums over these pairs of differences and of their products.

    No pair is made.  For each query and label the number, sums and products of its hits are taken, and
    running sums over labels give those of all lower labels; the sums over pairs follow from these.  Rows
    with a null label or feature are left out.
    """
    whole = rows.dropna(subset=["query_id", label, *features])
    places = range(len(features))
    both = [(i, j) for i in places for j in places if i <= j]
    x = [F.col(f).cast("double") for f in features]
    sums = [F.count("*").cast("double").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in places], *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in both]]
    level = whole.groupBy("query_id", label).agg(*sums)
    lower = Window.partitionBy("query_id").orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    level = level.select("*", *[F.sum(c).over(lower).alias(f"l_{c}") for c in level.columns if c not in ("query_id", label)]).filter("l_n IS NOT NULL")
    c = F.col
    out = [F.sum(c("n") * c("l_n")).alias("n"), *[F.sum(c("l_n") * c(f"s{i}") - c("n") * c(f"l_s{i}")).alias(f"b_{i}") for i in places]]
    out += [F.sum(c("l_n") * c(f"q{i}_{j}") + c("n") * c(f"l_q{i}_{j}") - c(f"s{i}") * c(f"l_s{j}") - c(f"l_s{i}") * c(f"s{j}")).alias(f"a_{i}_{j}") for i, j in both]
    return level.agg(*out)


def learned(rows: DataFrame, features: list[str], label: str = "label", ridge: float = 1e-3) -> list[float]:
    """Weights of features under which hits of a higher label score one more than those of a lower one, as near as can be.

    The least squares over all pairs of a query; what goes to the driver is one row.  Without any pair all weights are 0.
    """
    got = pair_moments(rows, features, label).first()
    if not got["n"]:
        return [0.0] * len(features)
    d = len(features)
    a = np.array([[got[f"a_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / got["n"]
    b = np.array([got[f"b_{i}"] for i in range(d)]) / got["n"]
    return np.linalg.solve(a + ridge * np.eye(d), b).tolist()


def scored(rows: DataFrame, features: list[str], weights: list[float]) -> DataFrame:
    """rows with their score under the weights; a null feature counts as 0."""
    total = F.lit(0.0)
    for name, weight in zip(features, weights, strict=True):
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(float(weight))
    return rows.withColumn("score", F.round(total, search.DIGITS))


def ndcg(hits: DataFrame, most: int = 10, label: str = "label") -> DataFrame:
    """(query_id, ndcg): discounted gain of the first hits by rank over that of the best order; 0 where no hit has a label above 0."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce(F.col(label), F.lit(0)).desc(), "id"))
    gain = F.pow(F.lit(2.0), F.coalesce(F.col(label), F.lit(0))) - 1
    rows = hits.withColumn("ideal", place)
    got, best = (F.sum(F.when(F.col(at) <= most, gain / F.log2(F.col(at) + 1)).otherwise(0.0)) for at in ("rank", "ideal"))
    return rows.groupBy("query_id").agg(F.round(F.when(best > 0, got / best).otherwise(0.0), search.DIGITS).alias("ndcg"))


# ---------------------------------------------------------------- scores


def normalised(hits: DataFrame) -> DataFrame:
    """hits with scores from 0 to 1 within each query; all 1 where they are equal."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return hits.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def boosted(hits: DataFrame, boosts: list[tuple[Column, float]]) -> DataFrame:
    """hits with each score multiplied by every factor whose condition holds; a condition that is null doesn't."""
    factor = F.lit(1.0)
    for condition, by in boosts:
        factor = factor * F.when(condition, F.lit(float(by))).otherwise(1.0)
    return hits.withColumn("score", F.round(F.col("score") * factor, search.DIGITS))


# ---------------------------------------------------------------- lists of queries


def chosen(relevance: np.ndarray, alike: np.ndarray, most: int, share: float) -> tuple[list[int], list[float]]:
    """Greedy choice of most rows: each the one of greatest share * relevance - (1 - share) * likeness to what is chosen; earlier rows win ties."""
    taken, gains, near = [], [], np.zeros(len(relevance))
    open_ = np.ones(len(relevance), bool)
    for _ in range(min(most, len(relevance))):
        gain = rounded(share * relevance - (1 - share) * near, search.DIGITS)
        best = int(np.where(open_, gain, -np.inf).argmax())
        taken.append(best)
        gains.append(float(gain[best]))
        open_[best] = False
        near = alike[best] if len(taken) == 1 else np.maximum(near, alike[best])
    return taken, gains


def diverse(hits: DataFrame, points: DataFrame, most: int = 10, share: float = 0.7) -> DataFrame:
    """(query_id, id, score, rank): of each query's hits (query_id, id, score) the most relevant that differ, one after another.

    Likeness is the cosine of the vectors of points (id, vector); a hit without a vector is like none.
    """
    pairs = stored(hits.select("query_id", "id", "score"), "to-diversify")
    few = search.small(stored(pairs.select("id").distinct(), "their-points"))
    both = pairs.join(search.small(stored(points.select("id", F.col("vector").cast("array<double>").alias("vector")).join(few, "id", "left_semi"), "their-vectors")), "id", "left").select("query_id", "id", "score", "vector")

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("score", "descending"), ("id", "ascending")]).combine_chunks()
        column = rows.column("vector").combine_chunks()
        sizes = np.asarray(column.value_lengths().fill_null(0))
        dim = int(sizes.max(initial=0))
        alike = np.zeros((rows.num_rows, rows.num_rows))
        if dim:
            which, x = matrix(column, dim)
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            alike[np.ix_(which, which)] = x @ x.T
        taken, gains = chosen(rows.column("score").to_numpy(), alike, most, share)
        own = rows.select(["query_id", "id"]).take(pa.array(taken, pa.int64()))
        return own.append_column("score", pa.array(gains)).append_column("rank", pa.array(range(1, len(taken) + 1), pa.int32()))

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    return both.groupBy("query_id").applyInArrow(work, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank int")


def in_windows(hits: DataFrame, better: str, width: int = 20, step: int = 10) -> DataFrame:
    """hits (query_id, id, rank, better) with the rank after sorting windows of each list, from its end to its front, by column better.

    As each window overlaps the next, a hit can rise to the front, but a window's scores are all that has
    to be known at a time.  Earlier ranks win ties; nulls come last.
    """

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank").combine_chunks()
        score = np.nan_to_num(rows.column(better).to_numpy().astype(np.float64), nan=-np.inf)
        order, stop = np.arange(rows.num_rows), rows.num_rows
        while stop > 0:
            begin = max(0, stop - width)
            order[begin:stop] = order[begin:stop][np.argsort(-score[order[begin:stop]], kind="stable")]
            stop = stop - step if begin else 0
        rows = rows.take(pa.array(order))
        return rows.set_column(rows.schema.get_field_index("rank"), "rank", pa.array(range(1, rows.num_rows + 1), pa.int32()))

    return hits.withColumn("rank", F.col("rank").cast("int")).groupBy("query_id").applyInArrow(work, hits.withColumn("rank", F.col("rank").cast("int")).schema)
