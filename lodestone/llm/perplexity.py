"""Quality rules on n-gram perplexity, with plain counting rules before them.

The language model is a modified Kneser-Ney model of character n-grams (ORDER characters) for each
language.  Spark counts the n-grams of all documents; an n-gram's 60-bit hash is its folded
characters, 12 bits each (exact below U+0C00), so the hash of its context and of its ending are
shifts and masks of it.  From the counted ones the lower orders follow as continuation counts, with
three discounts for each order.  Every n-gram's interpolated log-probability lies in one array beside
the sorted hashes; scoring is binary search.  Characters and not words: the model stays small whatever
the corpus (counts of word trigrams are as large as the corpus and could neither be shuffled within
the disk budget nor be held by each worker).

N-grams that stand only once are no evidence but of the one document they come from, which would then
foretell itself: they count in totals and discounts, and their share goes to the lower orders.

No n-gram is left out, however many there are.  Spark sums up those that stand once, by context; all
others are held as arrays, 12 bytes for each and for each context, by the driver and each worker.

A document is kept unless a base rule fails or its log-perplexity lies outside its language's band,
which spans BELOW and ABOVE robust deviations around the median of all its different texts that pass
the base rules; a short text's error, one over the root of its length, is added to the deviation as
independent errors add up.  Models and bands count equal texts of a language
once, so copies, however many, don't move them.

Words: ``[^\\x20\\x09-\\x0D]+``.  Defined cases: null text has no words and fails; a null language is
one of its own; repeated rows are judged alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import SPACE, Texts, code_points, grams, hashes, mixed, pieces, words
from lodestone.llm.shared import shared_table, temporary

ORDER = 5
FOLD = 12
SENT = 2_000_000  # hashes of repeated texts that are broadcast
LEAST = 2  # an n-gram that stands once in all documents tells nothing of any other document
BELOW, ABOVE = 3.5, 8.0  # how many deviations a band reaches; high values have a longer tail in clean texts
BIN = 0.005  # width of the histogram bins of log-perplexity
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(b"#*$%&|<>")] = 1
SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, log_ppl double, text_hash string"


def hashed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, texts padded in front; where each text's begin."""
    points, bounds = code_points(texts)
    folded = np.where(points < 3072, np.maximum(points, 1), 3072 + points % 1024).astype(np.uint64)
    pad = ORDER - 1
    at = np.arange(len(folded)) + np.repeat(pad * np.arange(1, texts.n + 1), np.diff(bounds))
    wide = np.zeros(len(folded) + pad * texts.n, np.uint64)
    wide[at] = folded
    key = np.zeros(max(0, len(wide) - pad), np.uint64)
    for k in range(ORDER):
        key |= wide[k : k + len(key)] << np.uint64(FOLD * (pad - k))
    return key[at - pad], bounds


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal hashes added up; sorted."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def different(docs: DataFrame) -> DataFrame:
    """(lang, text, share): one row of each different text of a language.

    Texts are told apart by a 64-bit hash and their length; of equal ones the row with the smallest
    doc_id stays (rows that share it too have a share of 1 together).  Only hashes are shuffled: those
    that stand more than once come back to the texts, broadcast while they are counted few.
    """
    keyed = docs.select("doc_id", "lang", "text", F.xxhash64("lang", "text").alias("h"), F.length("text").alias("len"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("n"))
    again = keyed.groupBy("h", "len", "doc_id").agg(F.count("*").alias("n")).groupBy("h", "len").agg(F.sum("n").alias("copies"), F.min(own).alias("first"))
    again = again.filter("copies > 1").select(F.col("h").alias("h2"), F.col("len").alias("len2"), F.col("first.doc_id").alias("first_id"), F.col("first.n").alias("same"))
    again = shared_table(again, "repeated-texts")
    both = keyed.join(F.broadcast(again) if again.count() <= SENT else again, (F.col("h") == F.col("h2")) & F.col("len").eqNullSafe(F.col("len2")), "left")
    return both.filter(F.col("same").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).select("lang", "text", (F.lit(1.0) / F.coalesce("same", F.lit(1))).alias("share"))


def counted(texts: DataFrame) -> DataFrame:
    """(lang, key, n): how often each n-gram stands in all texts (lang, text, share) of a language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, list] = {}
        for batch in batches:
            langs, shares = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy()
            for texts in pieces(batch.column(1)):
                key, bounds = hashed(texts)
                some = slice(texts.first, texts.first + texts.n)
                size = np.diff(bounds)
                for lang, share in set(zip(langs[some], shares[some].tolist(), strict=True)):
                    keys = np.sort(key[np.repeat((langs[some] == lang) & (shares[some] == share), size)])
                    if not len(keys):
                        continue
                    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    parts = found.setdefault(lang, [])
                    parts.append((keys[first], share * np.diff(np.append(first, len(keys)))))
                    if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > max(1 << 20, len(parts[0][0])):
                        found[lang] = [merged(parts)]
        for lang, parts in found.items():
            keys, counts = merged(parts)
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(counts[i : i + (1 << 16)])], names=["lang", "key", "n"])

    partial = texts.select("lang", "text", "share").mapInArrow(work, "lang string, key long, n double")
    return partial.groupBy("lang", "key").agg(F.round(F.sum("n")).cast("long").alias("n"))


class Model:
    """One language's arrays: for each order sorted hashes and log-probabilities, contexts and weights.

    N-grams that stand once may come as sums instead: ones is how many there are, and alone the sorted
    contexts of keys that some of them have, with how many.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, least: int = LEAST, ones: int = 0, alone: tuple[np.ndarray, np.ndarray] | None = None):
        levels, k, c = [], keys.astype(np.uint64), counts.astype(np.float64)
        held = c >= least
        for n in range(order, 0, -1):
            levels.append((n, k, c, held))
            if n > 1:
                k, c = np.unique(k[held] & np.uint64((1 << FOLD * (n - 1)) - 1), return_counts=True)
                c, held = c.astype(np.float64), np.ones(len(k), bool)
        self.levels: list[tuple] = []
        low = (np.zeros(0, np.uint64), np.zeros(0))
        for n, k, c, held in reversed(levels):
            own = c - self.discounts(c, ones if n == order else 0)[np.minimum(c, 3).astype(np.int64)]
            context = k >> np.uint64(FOLD)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), context[1:] != context[:-1])))
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
            total = np.bincount(which, c, len(first))
            if n == order and alone is not None:
                total[np.searchsorted(context[first], alone[0])] += alone[1]
            spared = total - np.bincount(which[held], own[held], len(first))  # what is left for lower orders
            ending = k[held] & np.uint64((1 << FOLD * (n - 1)) - 1)
            below = low[1][np.searchsorted(low[0], ending)] if n > 1 else np.full(len(ending), 1.0 / (1 << FOLD))
            p = own[held] / total[which[held]] + (spared / total)[which[held]] * below
            low = (k[held], p)
            used = np.bincount(which[held], minlength=len(first)) > 0
            self.levels.append((k[held], np.log(p).astype(np.float32), context[first][used], np.log(np.maximum(spared / total, 1e-12))[used].astype(np.float32)))

    @staticmethod
    def discounts(c: np.ndarray, ones: int = 0) -> np.ndarray:
        """0 and the discounts of counts 1, 2 and 3 or more; ones: counts of 1 besides c."""
        n1, n2, n3, n4 = (float((c == i).sum()) + (ones if i == 1 else 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        each = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
        return np.array([0.0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(each))])

    def log_p(self, key: np.ndarray, level: int = -1) -> np.ndarray:
        """Log-probability of each n-gram's last character after its others."""
        level %= len(self.levels)
        keys, log_p, contexts, weight = self.levels[level]
        if not len(keys):  # nothing is known at this order
            return np.full(len(key), -FOLD * np.log(2)) if level == 0 else self.log_p(key & np.uint64((1 << FOLD * level) - 1), level - 1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = log_p[at].astype(np.float64)
        if len(miss := np.flatnonzero(keys[at] != key)):
            lost = key[miss]
            if level == 0:
                out[miss] = weight[0] - FOLD * np.log(2)
            else:
                context = lost >> np.uint64(FOLD)
                c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                back = np.where(contexts[c] == context, weight[c], 0.0)
                out[miss] = back + self.log_p(lost & np.uint64((1 << FOLD * level) - 1), level - 1)
        return out


def models(docs: DataFrame) -> dict[str | None, Model]:
    """Each language's model, of all n-grams of its different texts."""
    table = shared_table(counted(different(docs)), "ngrams")
    # n-grams that stand once come to the driver as sums, for contexts that others have too
    by_context = table.groupBy("lang", F.shiftright("key", FOLD).alias("context")).agg(F.count_if(F.col("n") < LEAST).alias("alone"), F.max("n").alias("most"))
    by_context = shared_table(by_context.filter(F.col("alone") > 0), "contexts")
    ones = {r["lang"]: r["ones"] for r in by_context.groupBy("lang").agg(F.sum("alone").alias("ones")).collect()}
    out = {}
    for lang in {r["lang"] for r in table.select("lang").distinct().collect()}:
        mine = F.col("lang").eqNullSafe(F.lit(lang).cast("string"))
        got = table.filter(mine & (F.col("n") >= LEAST)).select("key", "n").toArrow()
        keys, n = got["key"].to_numpy().astype(np.uint64), got["n"].to_numpy()
        order = np.argsort(keys)
        few = by_context.filter(mine & (F.col("most") >= LEAST)).select("context", "alone").toArrow()
        contexts, alone = few["context"].to_numpy().astype(np.uint64), few["alone"].to_numpy()
        out[lang] = Model(keys[order], n[order], ones=ones.get(lang, 0), alone=(contexts, alone))
    return out


def counts(texts: Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, bounds = texts.data, texts.bounds
    starts, ends = words(texts)
    n_words = np.diff(texts.counts(starts))

    def held(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])

    chars = held(~SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = held(SYMBOL[data])
    # lines
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((bounds[:-1][np.diff(bounds) > 0], cut + 1)))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    stop = stop - (data[stop - 1] == 10) if len(begin) else stop
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[full], stop[full]
    line = (np.searchsorted(bounds, begin, "right") - 1).astype(np.uint64)
    key = mixed(hashes(data, begin, stop) ^ mixed(line + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    dup = np.bincount(line[again].astype(np.int64), minlength=texts.n)
    # words in windows of five that stand twice
    g, g_bounds = grams(hashes(data, starts, ends), texts.counts(starts), 5)
    many = np.diff(g_bounds)
    own = mixed(g ^ mixed(np.repeat(np.arange(1, texts.n + 1, dtype=np.uint64), many)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    word_bounds = texts.counts(starts)
    at = (np.arange(len(own)) + np.repeat(word_bounds[:-1] - g_bounds[:-1], many))[twice]
    cover = np.bincount(at, minlength=len(starts) + 5)[: len(starts) + 5] - np.bincount(at + 5, minlength=len(starts) + 5)[: len(starts) + 5]
    covered = np.cumsum(cover)[: len(starts)] > 0
    repeat = np.diff(np.concatenate(([0], np.cumsum(covered)))[word_bounds])
    return [n_words, chars, symbols, dup, repeat]


def scored(docs: DataFrame, model: dict[str | None, Model]) -> DataFrame:
    """The counts of each document, and its log-perplexity (null without characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for texts in pieces(batch.column(2)):
                key, bounds = hashed(texts)
                size, own = np.diff(bounds), langs[texts.first : texts.first + texts.n]
                log_p = np.zeros(len(key))
                for lang in set(own):
                    mine = np.repeat(own == lang, size)
                    if mine.any():
                        log_p[mine] = shared.value[lang].log_p(key[mine])
                mean = -np.diff(np.concatenate(([0.0], np.cumsum(log_p)))[bounds]) / np.maximum(size, 1)
                kept = [batch.column(k).slice(texts.first, texts.n) for k in (0, 1, 3)]
                numbers = [pa.array(x.astype(np.int64)) for x in (*counts(texts), size)]
                yield pa.RecordBatch.from_arrays([*kept[:2], *numbers, pa.array(mean, mask=size == 0), kept[2]], names=[c.split()[0] for c in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "lang", "text", F.md5("text")).mapInArrow(work, SCORED)


def bands(table: DataFrame) -> list[tuple]:
    """(lang, middle, below, above): the median of different texts and robust deviations, from histograms."""
    good = table.filter(~F.col("base_failed") & F.col("log_ppl").isNotNull()).select("lang", "text_hash", "log_ppl", "n_chars").dropDuplicates(["lang", "text_hash"])
    rows = good.groupBy("lang", F.floor(F.col("log_ppl") / BIN).alias("bin")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).collect()
    out = []
    for lang in {r["lang"] for r in rows}:
        own = sorted((r["bin"], r["n"]) for r in rows if r["lang"] == lang)
        at, upto = np.array([b for b, _ in own]), np.cumsum([n for _, n in own])
        low, mid, high = (BIN * (at[np.searchsorted(upto, q * upto[-1])] + 0.5) for q in (0.25, 0.5, 0.75))
        out.append((lang, float(mid), float(max((mid - low) / 0.6745, 0.02)), float(max((high - mid) / 0.6745, 0.02))))
    return out


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, log_ppl and the band, for every row of docs."""
    with temporary(docs.sparkSession):
        model = models(docs)
    table = scored(docs, model).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    table = shared_table(table, "perplexities")
    band = docs.sparkSession.createDataFrame(bands(table), "band_lang string, middle double, below double, above double")
    # a text of few characters strays further: its mean has a larger error
    error = F.lit(1.0) / F.greatest("n_chars", F.lit(1))
    least = F.col("middle") - BELOW * F.sqrt(F.col("below") * F.col("below") + error)
    most = F.col("middle") + ABOVE * F.sqrt(F.col("above") * F.col("above") + error)
    out = table.join(band, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    inside = F.coalesce(F.col("log_ppl").between(least, most), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", least.alias("least_log_ppl"), most.alias("most_log_ppl"))
