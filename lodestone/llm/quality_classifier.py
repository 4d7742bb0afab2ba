"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Tokens are maximal runs of one kind of character (letters, digits, other signs) between white space,
case kept; features are hashes of one and of two tokens in a row, where a single word that repeats the
token one or two places before it counts as "again" rather than as itself.  A text of T features has the value
1 / sqrt(T) for each occurrence, so a score is one sparse dot product: a gather and a sum.

Training takes at most MOST labelled rows of each class (all of each row's text); scoring covers every
row.  Labels come only from rows whose remainder is not the held-out one.

Defined cases: a null, empty or blank text has no features and scores as the bias alone; without any
usable label every score is 0.5; repeated rows score alike; an empty table gives an empty result;
other columns, also labels of the same names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import KIND, Texts, grams, hashes, pieces, runs, sums
from lodestone.llm.training import Ftrl, labelled, remainder, sampled, sigmoid

BITS = 20
MOST = 3000  # labelled rows of each class that training reads
EPOCHS = 4
AGAIN = np.array([0x5BD1E9955BD1E995, 0x1B873593CC9E2D51], np.uint64)  # a word that stood one or two tokens before


def features(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, and where each text's begin."""
    starts, ends = runs(texts, KIND)
    hashed, bounds = hashes(texts.data, starts, ends), texts.counts(starts)
    two, two_bounds = grams(hashed, bounds, 2)
    letters = KIND[texts.data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    h = hashed.copy()
    for back, again in ((1, AGAIN[0]), (2, AGAIN[1])):  # compared before any is replaced
        if len(h) > back:
            same = np.flatnonzero((hashed[back:] == hashed[:-back]) & letters[back:]) + back
            h[same[same - back >= np.repeat(bounds[:-1], np.diff(bounds))[same]]] = again
    # per text: its single tokens, then its pairs
    out = np.empty(len(h) + len(two), np.uint32)
    out_bounds = bounds + two_bounds
    out[np.arange(len(h)) + np.repeat(two_bounds[:-1], np.diff(bounds))] = h >> np.uint64(64 - bits)
    out[np.arange(len(two)) + np.repeat(bounds[1:], np.diff(two_bounds))] = two >> np.uint64(64 - bits)
    return out, out_bounds


def sample(docs: DataFrame, chosen: DataFrame) -> list[tuple[int, np.ndarray]]:
    """(label, feature numbers) of the sampled rows, whole texts, at most 2 * MOST rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                at, bounds = features(texts)
                blobs = [at[bounds[i] : bounds[i + 1]].tobytes() for i in range(texts.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), pa.array(blobs, pa.binary())], names=["y", "blob"])

    got = sampled(docs, chosen).mapInArrow(work, "y int, blob binary").toArrow()
    found = [(y, np.frombuffer(b, np.uint32)) for y, b in zip(got["y"].to_pylist(), got["blob"].to_pylist(), strict=True)]
    return sorted(found, key=lambda x: (x[0], len(x[1]), x[1][:64].tobytes()))


def train(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights by feature number, and the bias."""
    model, bias = Ftrl((1 << bits,), alpha=0.3, l1=0.3, l2=1.0), Ftrl((1,), alpha=0.1, l1=0.0, l2=0.0)
    prepared = []
    for y, at in rows:
        own, count = np.unique(at, return_counts=True)
        prepared.append((y, own, count / np.sqrt(max(1, len(at)))))
    order, zero = np.random.default_rng(7), np.zeros(1, np.int64)
    for _ in range(epochs):
        for i in order.permutation(len(prepared)):
            y, own, x = prepared[i]
            w, b = model.weights(own), bias.weights(zero)
            miss = sigmoid(w @ x + b[0]) - y
            model.update(own, w, miss * x)
            bias.update(zero, b, np.array([miss]))
    return model.weights().astype(np.float32), float(bias.weights(zero)[0])


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    chosen = labelled(labels, label, by, held_out, MOST)
    weights, bias = train(sample(docs, chosen))
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            for texts in pieces(batch.column(2)):
                at, bounds = features(texts)
                score = sigmoid(sums(weights[at], bounds) / np.sqrt(np.maximum(1, np.diff(bounds))) + bias)
                own = [batch.column(k).slice(texts.first, texts.n) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), by) == held_out).alias("held_out"), "text")
    return slim.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
