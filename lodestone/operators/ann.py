"""Approximate nearest points: an inverted file of vectors around centroids.

Centroids are fitted on a bounded sample (SAMPLE points, chosen by a hash of the id); every point is
indexed, in the cell of its nearest centroid, and cells are the folders of the written index.  A query
looks into the cells of its nearest centroids only, so folders that no query asks for aren't read.
How many cells follows from the recall that is asked for, measured within the sample: few where
vectors are clustered, most of them where they point everywhere.  Exact search (nearest.py) is the
default everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators.nearest import CELLS, METRICS, Best, blocks, matrix, rounded
from lodestone.operators.tables import new_folder

SAMPLE = 20_000  # points that centroids are fitted on
ROUNDS = 15


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def sampled(points: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Unit vectors of a sample of points (id, vector)."""
    some = points.filter("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(most).select(F.col("vector").cast("array<double>").alias("vector")).toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    column = some["vector"].combine_chunks()
    dim = int(np.bincount(np.diff(column.offsets.to_numpy())).argmax())
    return unit(matrix(column, dim)[1])


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of sampled vectors by k-means."""
    centers = x[np.random.default_rng(1).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(1)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        full = np.bincount(own, minlength=len(centers)) > 0
        centers = np.where(full[:, None], unit(total), centers)
    return centers


def probes_for(x: np.ndarray, centers: np.ndarray, recall: float, most: int = 10, queries: int = 300) -> int:
    """The fewest cells to probe so that searches within the sample find that share of the nearest points."""
    q = x[np.random.default_rng(2).permutation(len(x))[:queries]]
    if not len(q):
        return 1
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :most]
    cell = (x @ centers.T).argmax(1)[near]
    place = np.argsort(np.argsort(-(q @ centers.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, cell, axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def index(points: DataFrame, centers: np.ndarray, path: str | None = None) -> DataFrame:
    """(id, vector, cell): every point whose vector is whole, written by cell."""
    shared = points.sparkSession.sparkContext.broadcast(centers)
    key = to_arrow_type(points.schema["id"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            rows, x = matrix(batch.column(1), centers.shape[1])
            if len(rows):
                own = batch.take(pa.array(rows))
                cell = (unit(x) @ centers.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column(0).cast(key), own.column(1), pa.array(cell)], names=["id", "vector", "cell"])

    path = path or new_folder(points.sparkSession, "cells")
    kind = points.schema["id"].dataType.simpleString()
    rows = points.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(work, f"id {kind}, vector array<double>, cell int")
    rows.write.mode("overwrite").partitionBy("cell").parquet(path)
    return points.sparkSession.read.schema(f"id {kind}, vector array<double>, cell int").parquet(path)


def nearest(own: DataFrame, centers: np.ndarray, queries: DataFrame, most: int, probes: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score): candidates of each query (query_id, query) from the cells of its nearest centroids, not ranked yet."""
    out = None
    for ids, vectors in blocks(queries):
        near = np.argsort(-(unit(vectors) @ centers.T), axis=1, kind="stable")[:, :probes]
        by_cell = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        found = probed(own.filter(F.col("cell").isin(list(by_cell))), ids, vectors, by_cell, most, metric)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else own.limit(0).select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"))


def probed(own: DataFrame, ids: np.ndarray, vectors: np.ndarray, by_cell: dict[int, np.ndarray], most: int, metric: str) -> DataFrame:
    shared = own.sparkSession.sparkContext.broadcast((ids, vectors, by_cell))
    scores, more = METRICS[metric]
    key = to_arrow_type(own.schema["id"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, by_cell = shared.value
        best = Best(most, more)
        for batch in batches:
            rows, x = matrix(batch.column(1), q.shape[1])
            cell, names = batch.column(2).to_numpy(zero_copy_only=False)[rows], batch.column(0).to_numpy(zero_copy_only=False)[rows]
            names = names.astype("U") if names.dtype == object else names
            for c in np.unique(cell):
                asked, mine = by_cell[int(c)], np.flatnonzero(cell == c)
                for at in range(0, len(mine), max(1, CELLS // len(asked))):
                    some = mine[at : at + max(1, CELLS // len(asked))]
                    score = rounded(scores(x[some], q[asked]))
                    r, k = np.nonzero(best.sign * score <= best.bars(len(ids))[asked])
                    best.put(asked[k], names[some][r], score[r, k], len(ids))
        if best.id is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.cell]), pa.array(best.id.tolist(), key), pa.array(best.score)], names=["query_id", "id", "score"])

    return own.select("id", "vector", "cell").mapInArrow(work, f"query_id long, id {own.schema['id'].dataType.simpleString()}, score double")
