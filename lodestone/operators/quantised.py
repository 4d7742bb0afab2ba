"""Approximate nearest points over compressed vectors: a written index of cells and product-quantised residuals.

Each vector, scaled to length one, is put in the cell of its nearest centroid; what is left beside the
centroid is cut into PARTS pieces, and of each piece only the number of the nearest of CODES patterns is
kept: a byte.  There are as many cells as the square root of the number of points (while the sample
has enough for each), so a query's share of the points falls as they grow.

A search looks into the cells of a query's nearest centroids, as many as the wanted recall took within
the sample.  Scores there are sums of a table's entries, one for each byte of a code (the query stays
whole, only points are compressed).  The best RERANKED candidates of each result are then scored
exactly, from their own vectors, and only those are read.

Centroids and patterns are fitted on a bounded sample (ann.SAMPLE points chosen by a hash); every point is
indexed.  The index lies below a path and is opened from there; its model is written last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import vectors as V
from lodestone.operators import search
from lodestone.operators.ann import fitted, probes_for, sampled, unit
from lodestone.operators.nearest import CELLS, Best, blocks, matrix
from lodestone.operators.tables import stored

PARTS = 16
CODES = 256
EACH = 8  # sampled points that a cell has at least, on average
ROUNDS = 12
RERANKED = 20  # candidates that are scored exactly for each result
RECALL = 0.97

MODEL = "kind string, a int, b int, v array<double>"


@dataclass
class Model:
    """Centroids (cells x dimensions), patterns (parts x codes x dimensions of a part) and how many cells a search looks into."""

    centers: np.ndarray
    patterns: np.ndarray
    probes: int

    def pieces(self, x: np.ndarray) -> np.ndarray:
        """Vectors cut into parts, filled up with zeros."""
        parts, _, width = self.patterns.shape
        out = np.zeros((len(x), parts * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), parts, width)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the code (a byte for each part) of vectors."""
        x = unit(x)
        cell = (x @ self.centers.T).argmax(1)
        rest = self.pieces(x - self.centers[cell])
        code = [squares(rest[:, k], self.patterns[k]).argmin(1) for k in range(rest.shape[1])]
        return cell, np.stack(code, 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries, their products with all centroids and with all patterns."""
        q = unit(q)
        return q @ self.centers.T, np.einsum("qkw,kcw->qkc", self.pieces(q), self.patterns)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, but for a constant of each x."""
    return (y * y).sum(1) - 2 * x @ y.T


def patterns_of(rest: np.ndarray, codes: int) -> np.ndarray:
    """The patterns of one part, by k-means; fewer points than patterns leave some equal."""
    centers = rest[np.random.default_rng(4).permutation(len(rest))[:codes]]
    for _ in range(ROUNDS):
        own = squares(rest, centers).argmin(1)
        total, n = np.zeros_like(centers), np.bincount(own, minlength=len(centers))
        np.add.at(total, own, rest)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return np.concatenate((centers, np.repeat(centers[-1:], codes - len(centers), 0)))


def learned(x: np.ndarray, many: int, parts: int = PARTS, recall: float = RECALL) -> Model:
    """The model of unit vectors x, a sample of so many points."""
    cells = int(max(1, min(np.ceil(np.sqrt(many)), len(x) // EACH)))
    centers = fitted(x, cells)
    rest = x - centers[(x @ centers.T).argmax(1)]
    width = -(-x.shape[1] // parts)
    model = Model(centers, np.zeros((parts, CODES, width)), probes_for(x, centers, recall))
    cut = model.pieces(rest)
    model.patterns = np.stack([patterns_of(cut[:, k], CODES) for k in range(parts)])
    return model


@dataclass
class Quantised:
    """A written index: codes (id, code, cell) and vectors (id, vector, cell), by cell, and the model."""

    spark: SparkSession
    path: str

    @cached_property
    def model(self) -> Model:
        rows = self.spark.read.schema(MODEL).parquet(f"{self.path}/model").orderBy("kind", "a", "b").collect()
        of = {kind: [r for r in rows if r["kind"] == kind] for kind in ("center", "pattern", "probes")}
        patterns = np.array([r["v"] for r in of["pattern"]])
        return Model(np.array([r["v"] for r in of["center"]]), patterns.reshape(-1, CODES, patterns.shape[1]), of["probes"][0]["a"])

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def build(points: DataFrame, path: str, parts: int = PARTS, recall: float = RECALL) -> Quantised:
    """The index of points (id, vector), written below path; points without an id or a whole vector are left out."""
    spark = points.sparkSession
    points = points.filter("id IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))
    x = sampled(points)
    model = learned(x, points.count(), parts, recall) if len(x) else Model(np.zeros((1, 1)), np.zeros((parts, CODES, 1)), 0)
    shared, kind = spark.sparkContext.broadcast(model), points.schema["id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows, x = matrix(batch.column(1), model.centers.shape[1])
            if len(rows):
                own = batch.take(pa.array(rows))
                cell, code = model.encoded(x)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], names=["id", "vector", "code", "cell"])

    rows = stored(points.mapInArrow(work, f"id {kind.simpleString()}, vector array<double>, code binary, cell int"), "encoded")
    # dealt by cell, so there are about as many files as cells and not as cells times tasks; large cells are split, so none is one task's
    for name, part in (("codes", ["id", "code", "cell"]), ("vectors", ["id", "vector", "cell"])):
        rows.select(*part).hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{name}")
    saved = [("center", k, 0, v.tolist()) for k, v in enumerate(model.centers)] + [("probes", model.probes, 0, [])]
    saved += [("pattern", k, c, v.tolist()) for k, part in enumerate(model.patterns) for c, v in enumerate(part)]
    spark.createDataFrame(saved, MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return Quantised(spark, path)


def approximate(index: Quantised, ids: np.ndarray, vectors: np.ndarray, most: int, probes: int) -> DataFrame:
    """(query_id, id, cell, score): each task's best candidates by codes, for one block of queries."""
    model = index.model
    near = np.argsort(-(unit(vectors) @ model.centers.T), axis=1, kind="stable")[:, :probes]
    asked = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    shared = index.spark.sparkContext.broadcast((ids, asked, *model.tables(vectors)))
    codes = index.codes.filter(F.col("cell").isin(list(asked)))
    key = to_arrow_type(codes.schema["id"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, base, table = shared.value
        best = Best(most, True)
        for batch in batches:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            names = batch.column(0).to_numpy(zero_copy_only=False)
            names = names.astype("U") if names.dtype == object else names
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(cell), -1)
            for c in np.unique(cell):
                who, mine = asked[int(c)], np.flatnonzero(cell == c)
                step = max(1, CELLS // len(who))
                for at in range(0, len(mine), step):
                    some = mine[at : at + step]
                    score = np.repeat(base[who, c][None], len(some), 0)
                    for k in range(code.shape[1]):
                        score += table[who, k][:, code[some, k]].T
                    r, q = np.nonzero(-score <= best.bars(len(ids))[who])
                    best.put(who[q], names[some][r], score[r, q], len(ids))
        if best.id is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.cell]), pa.array(best.id.tolist(), key), pa.array(best.score)], names=["query_id", "id", "score"])

    return codes.select("id", "code", "cell").mapInArrow(work, f"query_id long, id {codes.schema['id'].dataType.simpleString()}, score double")


def nearest(index: Quantised, queries: DataFrame, most: int, probes: int | None = None, reranked: int = RERANKED) -> DataFrame:
    """(query_id, id, score, rank): points near queries (query_id, query) by cosine; scores are exact, a few of the nearest may be missing.

    Blocks of queries are worked through one after another, each block's result written before the next.
    """
    out, probes = None, probes or index.model.probes
    for ids, vectors in blocks(queries) if index.model.probes else ():  # an index of no points looks into no cell
        found = approximate(index, ids, vectors, most * reranked, probes)
        pairs = stored(search.best(found, most * reranked, "query_id").select("query_id", "id"), "candidates")
        wanted = search.small(stored(pairs.select("id").distinct(), "candidate-ids"))
        theirs = stored(index.vectors.select("id", "vector").join(wanted, "id", "left_semi"), "candidate-vectors")
        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
        both = pairs.join(search.small(theirs), "id").join(search.small(asked), "query_id")
        hits = search.best(both.select("query_id", "id", F.round(V.cosine(F.col("query"), F.col("vector")), search.DIGITS).alias("score")), most, "query_id")
        hits = stored(hits.select("query_id", "id", "score", "rank"), "near")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        kind = index.codes.schema["id"].dataType.simpleString() if index.model.probes else "long"
        return index.spark.createDataFrame([], f"query_id long, id {kind}, score double, rank int")
    return out
