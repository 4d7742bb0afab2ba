"""Follow-the-regularised-leader training on bounded samples, and the sampling itself.

Samples hold at most a documented number of labelled rows, chosen by a hash of their identifier: the
smallest hashes win, so reruns agree and no row's place in a file matters.  Each sampled row is used
with its whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the identifier as text, modulo by; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def labelled(labels: DataFrame, label: str, by: int, held_out: int, most: int) -> DataFrame:
    """(id, y): up to most rows of each of the two classes, none of them held out.

    Rows with a null id or label are left out; an id with both labels has the larger.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), by) != held_out))
    one = usable.groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("y"))
    parts = [one.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def sampled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(y, text): each different text of the chosen identifiers once, at most as many as were chosen.

    Of one identifier with several texts the one with the smallest hash is taken, so rows that share
    an identifier don't enlarge the sample.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    return rows.groupBy("id").agg(F.min_by(F.struct("y", "text"), F.struct(F.xxhash64("text"), "text")).alias("row")).select("row.y", "row.text")


class Ftrl:
    """FTRL-proximal for sparse rows; weights may have several columns (one for each class)."""

    def __init__(self, shape: tuple[int, ...], alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, rows: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step for the distinct rows, whose weights are w, along gradient g."""
        n = self.n[rows]
        more = n + g * g
        self.z[rows] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = more


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
