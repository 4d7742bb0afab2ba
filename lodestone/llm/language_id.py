"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, every run of other characters is one blank, and n-grams of one to three
characters are hashed.  A text's feature has the value SCALE * (its share of the text's n-grams) * idf,
so scoring is a gather and a sum.  The model is trained by follow-the-regularised-leader with an
elastic net (l1 keeps it sparse), and its temperature is set on a fifth of the sample kept apart.

Training takes at most MOST different labelled rows of each language, TOTAL in all (but one of each language
at least), chosen by a hash, with their whole texts; prediction covers every row.  Labels come only from rows
whose remainder is not the held-out one, idf too.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled row
every text is; a row without language teaches nothing; repeated rows are predicted alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm.batches import Texts, code_points, pieces, sums
from lodestone.llm.shared import shared_table
from lodestone.llm.training import Ftrl, remainder

BITS = 18
MOST = 1500  # labelled rows of each language that training reads
TOTAL = 12000  # in all, while there are no more languages than that
EPOCHS = 3
SCALE = 30.0
UNKNOWN = "und"


@cache
def alphabet() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    out = np.full(0x110000, 32, np.uint64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def features(texts: Texts, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 1, 2, 3 the feature at each character (2 ** bits where none begins); bounds; has letters."""
    points, bounds = code_points(texts)
    c = alphabet()[points]
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    lettered = np.concatenate(([0], np.cumsum(~blank)))[bounds]
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    c = c[keep]
    out, shift, mix = [], np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
    v = c.copy()
    for n in (1, 2, 3):
        if n > 1:
            v[: 1 - n] |= c[n - 1 :] << np.uint64(21 * (n - 1))
        f = ((v * mix) >> shift).astype(np.int32)
        for back in range(1, n):  # where an n-gram would reach into the next text
            at = bounds[1:] - back
            f[at[at >= bounds[:-1]]] = 1 << bits
        out.append(f)
    return out, bounds, np.diff(lettered) > 0


def least_keys(rows: DataFrame, each: int) -> DataFrame:
    """(lang, key): of each language the smallest different keys, each at most; a task sends no more than that of any language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, keys = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                kept[lang] = np.unique(np.concatenate((kept.get(lang, keys[:0]), keys[code == k])))[:each]
        for lang, keys in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys)], names=["lang", "key"])

    different = rows.select("lang", "key").mapInArrow(work, "lang string, key long").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return different.withColumn("rank", rank).filter(F.col("rank") <= each).drop("rank")


def sample(docs: DataFrame, by: int, held_out: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, counts) of at most MOST different rows of each language, and of one at least.

    Rows with the smallest hashes of identifier and text are taken, each once however often it stands in
    the table, so rows that share an identifier, or have none, are told apart by their texts.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), by) != held_out))
    keyed = known.select("lang", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("key"), "text")
    each = max(1, min(MOST, TOTAL // max(1, known.select("lang").distinct().count())))
    chosen = shared_table(least_keys(keyed, each).select(F.col("lang").alias("l"), F.col("key").alias("k")), "language-sample")
    rows = keyed.join(F.broadcast(chosen), (F.col("lang") == F.col("l")) & (F.col("key") == F.col("k"))).select("lang", "key", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = [i for i, name in enumerate(names) if not (name in seen or seen.add(name))]
            batch = batch.take(pa.array(new, pa.int64()))
            for texts in pieces(batch.column(2)):
                parts, bounds, _ = features(texts)
                own = [np.unique(np.concatenate([p[bounds[i] : bounds[i + 1]] for p in parts]), return_counts=True) for i in range(texts.n)]
                own = [(f[f < 1 << BITS], n[f < 1 << BITS]) for f, n in own]
                blobs = (pa.array([x[k].astype(np.uint32).tobytes() for x in own], pa.binary()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(texts.first, texts.n) for k in (0, 1)), *blobs], names=["lang", "key", "f", "n"])

    once = rows.mapInArrow(work, "lang string, key long, f binary, n binary").dropDuplicates(["lang", "key"])
    got = once.toArrow().to_pydict()
    found = [(y, np.frombuffer(f, np.uint32).astype(np.int64), np.frombuffer(n, np.uint32)) for y, f, n in zip(got["lang"], got["f"], got["n"], strict=True)]
    return sorted((x for x in found if len(x[1])), key=lambda x: (x[0], len(x[1]), x[1][:64].tobytes(), x[2][:64].tobytes()))


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages; for each feature the value (idf, scale and temperature included) for each; bias."""
    names = sorted({y for y, _, _ in rows})
    spread = np.zeros(1 << BITS)
    for _, f, _ in rows:
        spread[f] += 1
    idf = np.log((1 + len(rows)) / (1 + spread)) + 1
    prepared = [(names.index(y), f, SCALE * n / n.sum() * idf[f]) for y, f, n in rows]
    order = np.random.default_rng(5).permutation(len(prepared))
    apart, taught = order[: len(order) // 5], order[len(order) // 5 :]
    model, bias = Ftrl((1 << BITS, len(names)), alpha=0.5, l1=0.5, l2=0.1), Ftrl((1, len(names)), alpha=0.1, l1=0.0, l2=1.0)
    shuffle, zero = np.random.default_rng(3), np.zeros(1, np.int64)
    for _ in range(epochs):
        for i in shuffle.permutation(taught):
            y, f, x = prepared[i]
            w, b = model.weights(f), bias.weights(zero)
            p = softmax(x @ w + b[0])
            p[y] -= 1
            model.update(f, w, x[:, None] * p)
            bias.update(zero, b, p[None])
    weights, b = model.weights(), bias.weights(zero)[0]
    scores = np.array([x @ weights[f] + b for y, f, x in (prepared[i] for i in apart)]).reshape(-1, len(names))
    truth = np.array([prepared[i][0] for i in apart], np.int64)

    def loss(t: float) -> float:
        p = softmax(scores / t)
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).sum()

    warm = min(np.geomspace(0.25, 8, 41), key=loss) if len(truth) else 1.0
    return names, weights * (idf * SCALE)[:, None] / warm, b / warm


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def predicted(docs: DataFrame, by: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    return tagged(docs.select("doc_id", "text", (remainder(F.col("doc_id"), by) == held_out).alias("held_out")), learned(docs, by, held_out)).select("doc_id", "held_out", "lang_pred", "score")


def learned(docs: DataFrame, by: int = 3, held_out: int = 1) -> tuple:
    """The model as workers use it: languages, row number of each feature, the rows with weights, bias."""
    rows = sample(docs, by, held_out)
    if not rows:
        return [], np.zeros((1 << BITS) + 1, np.int32), np.zeros((1, 0), np.float32), np.zeros(0)
    names, weights, bias = train(rows)
    used = np.flatnonzero(np.any(weights != 0, axis=1))
    place = np.zeros((1 << BITS) + 1, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    return names, place, np.concatenate((np.zeros((1, len(names))), weights[used])).astype(np.float32), bias


def tagged(docs: DataFrame, model: tuple, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score added under names that docs doesn't have; all else as it was."""
    lang_name, score_name = names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place, weights, bias = shared.value
        for batch in batches:
            for texts in pieces(batch.column(at)):
                parts, bounds, lettered = features(texts)
                known = lettered & bool(names)
                lang, score = np.full(texts.n, UNKNOWN, object), np.zeros(texts.n)
                if known.any():
                    size = np.diff(bounds)
                    many = np.maximum(1, sum(np.maximum(size - n + 1, 0) for n in (1, 2, 3)))
                    total = sum(sums(weights[place[f]], bounds) for f in parts)
                    p = softmax(total / many[:, None] + bias)
                    best = p.argmax(1)
                    lang[known] = np.array(names, object)[best[known]]
                    score[known] = p[np.arange(texts.n), best][known]
                own = [batch.column(k).slice(texts.first, texts.n) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, lang_name, score_name])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())]))
