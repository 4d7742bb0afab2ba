"""Toxicity by multiple-instance learning: documents have labels, sentences get scores.

A sentence scores sigmoid(b + sum of the weights of its distinct hashed words and word beginnings); a document is toxic
unless all its sentences are clean (noisy-or): 1 - prod(1 - p).  Training follows the gradient of the
document's log-likelihood through the noisy-or into the sentences, with FTRL, so from labels of whole
documents it finds the words that make sentences toxic.

In scoring, only sentences over LOCATED enter the noisy-or; they name the places.  Of sentences with
the same weighted words one counts, as a repeated sentence is no new evidence.  So a text's length
alone never makes it toxic: without any such sentence its score is that of its strongest sentence,
which is below LOCATED, and a predicted document always has an offending sentence.

Training takes at most MOST labelled rows of each class, whole texts; scoring covers every row.
Labels come only from rows whose remainder is not the held-out one.  The bias is fixed low, as most
sentences are clean.

Defined cases: a null, empty or blank text has no sentence and score 0; without any usable label every
weight is 0; repeated rows score alike, and teach once; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import KIND, LOWER, Texts, hashes, mixed, pieces, runs
from lodestone.llm.training import Ftrl, labelled, remainder, sampled, sigmoid

BITS = 20
MOST = 3000  # labelled rows of each class that training reads
EPOCHS = 8
LEAST = 3  # sampled rows that must have a feature for it to be learned
PREFIXES = (4, 5, 6, 7, 8)  # a word longer than so many characters also counts by its beginning
BIAS = -7.0  # a sentence without any weighted word has p = 0.0009
LOCATED = 0.3
LETTERS = (KIND == 1).astype(np.uint8)
END = np.zeros(256, bool)
END[list(b".!?\n")] = True


def instances(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence) pairs of all texts, in any order, and where each text's sentences begin.

    A sentence ends at . ! ? or a line's end, and counts if a word follows before the next end.
    """
    low = Texts(texts.first, LOWER[texts.data], texts.bounds)
    starts, ends = runs(low, LETTERS)
    ended = np.concatenate(([0], np.cumsum(END[texts.data])))
    doc = np.searchsorted(texts.bounds, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (ended[starts[1:]] != ended[starts[:-1]]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    first = np.concatenate((sentence, [new.sum()]))[texts.counts(starts)]
    lead = np.append(np.flatnonzero((low.data & 0xC0) != 0x80), len(low.data))  # where characters begin
    nth = np.searchsorted(lead, starts)
    spans, of = [(starts, ends)], [sentence]
    for k in PREFIXES:
        cut = lead[np.minimum(nth + k, len(lead) - 1)]
        longer = cut < ends
        spans.append((starts[longer], cut[longer]))
        of.append(sentence[longer])
    begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    return (hashes(low.data, begin, end) >> np.uint64(64 - bits)).astype(np.uint32), np.concatenate(of), first


def sample(docs: DataFrame, chosen: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, features, sentences) of the sampled rows, whole texts, at most 2 * MOST rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                feature, sentence, first = instances(texts)
                order = np.lexsort((feature, sentence))
                feature, sentence = feature[order], sentence[order]
                at = np.searchsorted(sentence, first)
                out = [[feature[at[i] : at[i + 1]].tobytes(), (sentence[at[i] : at[i + 1]] - first[i]).astype(np.uint32).tobytes()] for i in range(texts.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), *(pa.array([x[k] for x in out], pa.binary()) for k in (0, 1))], names=["y", "feature", "sentence"])

    got = sampled(docs, chosen).mapInArrow(work, "y int, feature binary, sentence binary").toArrow().to_pydict()
    found = [(y, np.frombuffer(f, np.uint32), np.frombuffer(s, np.uint32)) for y, f, s in zip(got["y"], got["feature"], got["sentence"], strict=True)]
    return sorted(found, key=lambda x: (x[0], len(x[1]), x[1][:64].tobytes()))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the hashed words."""
    model = Ftrl((1 << bits,), alpha=2.0, l1=2.0, l2=0.0)
    prepared, spread = [], np.zeros(1 << bits, np.int32)
    for _, feature, _ in rows:
        spread[np.unique(feature)] += 1
    for y, feature, sentence in rows:
        common = spread[feature] >= LEAST
        feature, sentence = feature[common], sentence[common]
        pair = np.unique(sentence.astype(np.uint64) << np.uint64(32) | feature)
        own, place = np.unique((pair & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
        if len(own):
            prepared.append((y, own, place, (pair >> np.uint64(32)).astype(np.int64)))
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(prepared)):
            y, own, place, sentence = prepared[i]
            w = model.weights(own)
            p = sigmoid(np.bincount(sentence, w[place]) + BIAS)
            clean = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            slope = -p * clean / max(1 - clean, 1e-6) if y else p
            model.update(own, w, np.bincount(place, slope[sentence], len(own)))
    return model.weights().astype(np.float32)


def sentence_scores(texts: Texts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each sentence, a number for its weighted words, and where each text's sentences begin."""
    feature, sentence, first = instances(texts)
    value = weights[feature]
    hot = np.flatnonzero(value)  # few words carry weight; only those are made distinct by sentence
    pair, where = np.unique(sentence[hot].astype(np.uint64) << np.uint64(32) | feature[hot], return_index=True)
    of = (pair >> np.uint64(32)).astype(np.int64)
    total = np.bincount(of, value[hot][where], int(first[-1]))
    same = np.zeros(int(first[-1]), np.uint64)
    np.add.at(same, of, mixed(pair & np.uint64(0xFFFFFFFF)))
    return sigmoid(total + BIAS), same, first


def document_scores(p: np.ndarray, same: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's noisy-or of its different sentences over LOCATED, or else its strongest sentence; those over LOCATED."""
    n = len(first) - 1
    strongest = np.zeros(n)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        strongest[full] = np.maximum.reduceat(p, first[:-1][full])
    bad = np.flatnonzero(p >= LOCATED)
    doc = np.searchsorted(first, bad, "right") - 1
    key = mixed(same[bad] ^ mixed(doc.astype(np.uint64)))
    _, once = np.unique(key, return_index=True)
    clean = np.bincount(doc[once], np.log1p(-np.minimum(p[bad][once], 1 - 1e-9)), n)
    return np.maximum(1 - np.exp(clean), strongest), bad


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", by: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending for every row of docs.

    offending lists the numbers of the sentences over LOCATED, from 0, in order.
    """
    chosen = labelled(labels, label, by, held_out, MOST)
    weights = train(sample(docs, chosen))
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            for texts in pieces(batch.column(2)):
                p, same, first = sentence_scores(texts, weights)
                score, bad = document_scores(p, same, first)
                of = np.searchsorted(bad, first)
                offending = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(bad - np.repeat(first[:-1], np.diff(of)), pa.int32()))
                own = [batch.column(k).slice(texts.first, texts.n) for k in (0, 1)]
                arrays = [*own, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.diff(first), pa.int32()), offending]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])

    slim = docs.select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), by) == held_out).alias("held_out"), "text")
    return slim.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int, n_sentences int, offending array<int>")
