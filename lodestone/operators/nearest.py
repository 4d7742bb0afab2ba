"""Exact nearest points of a stated set of queries, as matrix products over Arrow batches.

Queries are taken in blocks that fit a broadcast; points are never moved.  Each task keeps, for every
query (and group), its best points so far, so only those leave it, however many points there are.
Scores are rounded (half away from zero) before they are ranked, and ties go to the smaller id.

Points and queries whose vector is null, holds a null, or has another number of dimensions than the
first query's are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

DIGITS = 6  # scores are ranked as rounded, so that engines agree on ties
MOST_QUERIES = 10_000  # queries of one block
MOST_BYTES = 32 << 20  # and bytes of their vectors
CELLS = 1 << 21  # scores that are computed at once
PAIRS = 1 << 18  # and that are given out at once, where all are


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x) + 0.0


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))
    return np.divide(x @ q.T, size, out=np.zeros((len(x), len(q))), where=size > 0)


def added(x: np.ndarray, q: np.ndarray, each) -> np.ndarray:
    """Sums of a function of differences, one dimension after another."""
    out = np.zeros((len(x), len(q)))
    for k in range(q.shape[1]):
        out += each(x[:, k, None] - q[:, k])
    return out


#: for each metric its scores, and whether more is better
METRICS = {
    "cosine": (cosine, True),
    "dot": (lambda x, q: x @ q.T, True),
    "euclid": (lambda x, q: np.sqrt(added(x, q, np.square)), False),
    "manhattan": (lambda x, q: added(x, q, np.abs), False),
}


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a whole vector of so many dimensions, and their vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values
    bad = np.zeros(len(values), bool) if not values.null_count else values.is_null().to_numpy(zero_copy_only=False)
    holes = np.concatenate(([0], np.cumsum(bad)))[column.offsets.to_numpy()]
    whole = (sizes == dim) & (np.diff(holes) == 0) & column.is_valid().to_numpy(zero_copy_only=False)
    numbers = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1][whole]
    return np.flatnonzero(whole), numbers[starts[:, None] + np.arange(dim)]


class Best:
    """The best so many rows of each cell (a query, or a query and a group)."""

    def __init__(self, most: int, more: bool):
        self.most, self.sign = most, -1.0 if more else 1.0
        self.cell, self.id, self.score = np.zeros(0, np.int64), None, np.zeros(0)
        self.bar = np.zeros(0)

    def bars(self, cells: int) -> np.ndarray:
        """For each cell, what a score must reach to count (lower is better)."""
        if len(self.bar) < cells:
            self.bar = np.concatenate((self.bar, np.full(cells - len(self.bar), np.inf)))
        return self.bar

    def put(self, cell: np.ndarray, ident: np.ndarray, score: np.ndarray, cells: int) -> None:
        cell, score = np.concatenate((self.cell, cell)), np.concatenate((self.score, score))
        ident = ident if self.id is None else np.concatenate((self.id, ident))
        order = np.lexsort((ident, self.sign * score, cell))
        cell, ident, score = cell[order], ident[order], score[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
        rank = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        keep = rank < self.most
        last = rank == self.most - 1
        self.bars(cells)[cell[last]] = self.sign * score[last]
        self.cell, self.id, self.score = cell[keep], ident[keep], score[keep]


def block(points: DataFrame, ids: np.ndarray, vectors: np.ndarray, most: int, metric: str, group: str | None) -> DataFrame:
    """Each task's best points of one block of queries."""
    shared = points.sparkSession.sparkContext.broadcast((ids, vectors))
    scores, more = METRICS[metric]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best, groups, first = Best(most, more), {}, 64
        for batch in batches:
            rows, x = matrix(batch.column(1), q.shape[1])
            own = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            own = own.astype("U") if own.dtype == object else own
            names = batch.column(2).to_pylist() if group else [None] * batch.num_rows
            code = np.array([groups.setdefault(names[i], len(groups)) for i in rows], np.int64)
            cells, at = max(1, len(groups)) * len(ids), 0
            while at < len(rows):
                step = max(1, min(first, CELLS // len(ids)))
                first *= 2  # few at first, so that bars are known before many scores are compared
                score = rounded(scores(x[at : at + step], q))
                bar = best.bars(cells).reshape(-1, len(ids))[code[at : at + step]]
                r, c = np.nonzero(best.sign * score <= bar)
                best.put(code[at + r] * len(ids) + c, own[at + r], score[r, c], cells)
                at += step
        labels = list(groups)
        if best.id is None:
            return
        out = [pa.array(ids[best.cell % len(ids)]), pa.array(best.id.tolist(), key), pa.array(best.score)]
        if group:
            out.append(pa.array([labels[k] for k in (best.cell // len(ids)).tolist()], kind))
        yield pa.RecordBatch.from_arrays(out, names=names_out)

    names_out = ["query_id", "id", "score", *([group] if group else [])]
    schema = f"query_id long, id {points.schema['id'].dataType.simpleString()}, score double"
    key, kind = to_arrow_type(points.schema["id"].dataType), None
    if group:
        kind = to_arrow_type(points.schema[group].dataType)
        schema += f", `{group}` {points.schema[group].dataType.simpleString()}"
    return points.select("id", F.col("vector").cast("array<double>"), *([group] if group else [])).filter("id IS NOT NULL").mapInArrow(work, schema)


def blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and vectors of the queries (query_id, query), block by block."""
    whole = queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>").alias("query")).filter("query_id IS NOT NULL AND query IS NOT NULL")
    many, dim = whole.agg(F.count("*"), F.min_by(F.size("query"), "query_id")).first()
    parts = -(-many // max(1, min(MOST_QUERIES, MOST_BYTES // (8 * max(1, dim or 1)))))
    for k in range(parts):
        some = whole if parts == 1 else whole.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
        got = some.toArrow()
        if got.num_rows:
            rows, vectors = matrix(got["query"].combine_chunks(), dim)
            yield got["query_id"].to_numpy()[rows], vectors


def nearest(points: DataFrame, queries: DataFrame, most: int, metric: str = "cosine", group: str | None = None) -> DataFrame:
    """Best points (id, vector, group) of each query, and group: the candidates of all tasks, not ranked yet."""
    out = None
    for ids, vectors in blocks(queries):
        found = block(points, ids, vectors, most, metric, group)
        out = found if out is None else out.unionByName(found)
    if out is None:
        extra = f", `{group}` {points.schema[group].dataType.simpleString()}" if group else ""
        return points.sparkSession.createDataFrame([], f"query_id long, id {points.schema['id'].dataType.simpleString()}, score double{extra}")
    return out


def by_size(column: pa.Array) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """Vectors by their number of dimensions (dimensions, rows, vectors), and each row's length; NaN where there is no whole vector."""
    sizes, out, norms = np.diff(column.offsets.to_numpy()), [], np.full(len(column), np.nan)
    for dim in np.unique(sizes[column.is_valid().to_numpy(zero_copy_only=False)]).tolist():
        rows, x = matrix(column, dim)
        norms[rows] = np.sqrt((x * x).sum(1))
        out.append((dim, rows, x))
    return out, norms


def cosines(points: DataFrame, queries: pa.Table) -> DataFrame:
    """(query_id, id, score): every point (id, vector) with each query (query_id, query) of one block.

    No score where a vector is missing, holds a null, or the two differ in dimensions; 0 where one is all zeros.
    """
    names = queries["query_id"].combine_chunks()
    shared = points.sparkSession.sparkContext.broadcast((names, *by_size(queries["query"].combine_chunks())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, lengths = shared.value
        step, asked = max(1, PAIRS // max(1, len(names))), {dim: (rows, q) for dim, rows, q in asked}
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                own, norms = by_size(batch.column(1))
                dots = np.zeros((batch.num_rows, len(names)))
                none = np.ones(dots.shape, bool)
                for dim, rows, x in own:
                    if dim in asked:
                        at = np.ix_(rows, asked[dim][0])
                        dots[at], none[at] = x @ asked[dim][1].T, False
                size = norms[:, None] * lengths
                none &= size != 0
                score = np.divide(dots, size, out=np.zeros_like(dots), where=size != 0)
                score = rounded(score).ravel()
                of = pa.array(np.repeat(np.arange(batch.num_rows, dtype=np.int32), len(names)))
                ids = pa.array(np.tile(np.arange(len(names), dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([names.take(ids), batch.column(0).take(of), pa.array(score, mask=none.ravel())], names=["query_id", "id", "score"])

    return points.select("id", F.col("vector").cast("array<double>")).mapInArrow(work, f"query_id {from_arrow_type(names.type).simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double")
