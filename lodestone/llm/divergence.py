"""Source divergence audit: how far each source's word use is from that of others, and by which terms.

Exact, in whole numbers, by integer-dictionary encoding:

1. Counts.  Terms are cut from the bytes of whole batches and encoded as dictionary codes; Spark sums
   (lang, source, term): in how many documents, and how often.
2. Chunks.  The counts are dealt by ranges of (lang, term), so all sources of a term meet and the terms
   kept (in at least LEAST documents of the language) are known without a join.  A chunk is a run of
   neighbouring terms of one language, bounded in terms and in rows.
3. Vectors.  In a chunk, ids are found by searchsorted in the sorted array of its kept terms, and a
   bincount for each group gives a dense vector; distances of groups are sums over vectors.  Ids are in
   UTF-8 order, as are chunks, so ties are settled by comparing ids.
4. Sums over chunks, and ranks.

A chunk's task holds one number for each pair of the language's sources, as the result has a row for each.

Defined cases: null text, lang and source are empty strings; a group without terms has counts of 0; a
language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs;
repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import KIND, LOWER, pieces, runs
from lodestone.llm.shared import shared_table, temporary

LEAST = 30  # documents of a language that a kept term is in
ADDED = 5
SCALE_STEPS = 3  # shares are in thousandths, this often
TOP = 50
ROWS = 500_000  # counts that a task sorts
CHUNK_TERMS = 4096
CHUNK_ROWS = 200_000
CELLS = 1 << 21  # of the dense vectors held at once

COUNTS = "lang string, source string, term string, df long, n long"
CODED = "lang string, chunk long, source string, term string, n long, opens boolean"
FOUND = "lang string, part string, source string, item string, value long"


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, df, n): documents that have the term, and its occurrences, of each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], names=["lang", "source"])
            names = {}
            own = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
            pairs = list(names)
            for texts in pieces(batch.column(0)):
                letters = KIND[texts.data] == 1
                starts, ends = runs(texts, (KIND == 1).astype(np.uint8))
                if not len(starts):
                    continue
                offsets = np.concatenate(([0], np.cumsum(ends - starts)))
                terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[texts.data[letters]])).dictionary_encode()
                n_terms = len(terms.dictionary)
                text = np.repeat(np.arange(texts.n), np.diff(texts.counts(starts)))
                once, n = np.unique(text * n_terms + terms.indices.to_numpy(), return_counts=True)
                group = own[texts.first + once // n_terms]
                key, back = np.unique(group * n_terms + once % n_terms, return_inverse=True)
                df, total = np.bincount(back), np.bincount(back, n).astype(np.int64)
                lang, source = (pa.array([p[k] for p in pairs], pa.string()).take(pa.array(key // n_terms)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, terms.dictionary.take(pa.array(key % n_terms)).cast(pa.string()), pa.array(df.astype(np.int64)), pa.array(total)], names=["lang", "source", "term", "df", "n"])

    cut = docs.select("text", filled("lang"), filled("source")).mapInArrow(work, COUNTS)
    return cut.groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def coded(counts: DataFrame, least: int, parts: int) -> DataFrame:
    """Counts of kept terms, in chunks; opens marks the first row of each term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, lang, n_terms, n_rows = TaskContext.get().partitionId() << 32, None, 0, 0
        for rows in whole_terms(batches):
            first = edges(rows)
            keep = np.add.reduceat(rows.column("df").to_numpy(), first) >= least
            sizes = np.diff(np.append(first, rows.num_rows))
            langs = rows.column("lang").take(pa.array(first)).to_pylist()
            of_term = np.empty(len(first), np.int64)
            for i in np.flatnonzero(keep):
                if langs[i] != lang or n_terms >= CHUNK_TERMS or n_rows + sizes[i] > CHUNK_ROWS:
                    chunk, lang, n_terms, n_rows = chunk + 1, langs[i], 0, 0
                n_terms, n_rows, of_term[i] = n_terms + 1, n_rows + sizes[i], chunk
            opens = np.zeros(rows.num_rows, bool)
            opens[first] = True
            kept = np.repeat(keep, sizes)
            out = rows.append_column("chunk", pa.array(np.repeat(of_term, sizes))).append_column("opens", pa.array(opens)).filter(pa.array(kept))
            yield from out.select(["lang", "chunk", "source", "term", "n", "opens"]).combine_chunks().to_batches()

    return counts.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(work, CODED)


def edges(rows: pa.Table) -> np.ndarray:
    """Where each (lang, term) of sorted rows begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in ("lang", "term"):
        code = rows.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, cut only between terms."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        last = int(edges(rows)[-1])
        if last:
            yield rows.slice(0, last).combine_chunks()
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(1000 ** SCALE_STEPS * (count + ADDED) / (total + ADDED * terms)), by long division, so nothing overflows."""
    by = total + ADDED * terms
    out, rest = np.divmod(count + ADDED, by)
    for _ in range(SCALE_STEPS):
        more, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + more
    return out + 1


def compared(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one chunk: each pair's sum of differences (smaller source first), and each group's TOP terms."""
    groups = groups.sort_by("source")
    lang, terms = groups.column("lang")[0].as_py(), groups.column("kept")[0].as_py()
    sources, totals = groups.column("source").to_pylist(), groups.column("total").to_numpy()
    n = len(sources)
    encoded = rows.column("term").combine_chunks().dictionary_encode()
    names = np.array([t.encode() for t in encoded.dictionary.to_pylist()], object)
    kept = np.sort(names)
    ids = np.searchsorted(kept, names)[encoded.indices.to_numpy()] if len(kept) else np.zeros(0, np.int64)
    place = {s: i for i, s in enumerate(sources)}
    group = np.array([place[s] for s in rows.column("source").to_pylist()], np.int64)
    many = rows.column("n").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, group, many = ids[order], group[order], many[order]
    between = np.zeros((n, n), np.int64)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    block = max(1, CELLS // n)
    for begin in range(0, len(kept), block):
        width = min(block, len(kept) - begin)
        a, b = np.searchsorted(ids, [begin, begin + width])
        count = np.zeros((n, width), np.int64)
        np.add.at(count, (group[a:b], ids[a:b] - begin), many[a:b])
        p, q = shares(count, totals[:, None], terms), shares(count.sum(0), totals.sum(), terms)
        for i in range(n):
            between[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(1)
            own = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value, at = np.concatenate((best[i][0], (p[i] - q)[own])), np.concatenate((best[i][1], own + begin))
            first = np.lexsort((at, -value))[:TOP]
            best[i] = value[first], at[first]
    left, right = np.triu_indices(n, 1)
    pair = [np.array(sources, object)[left], np.array(sources, object)[right], between[left, right]]
    term = [np.repeat(np.array(sources, object), [len(v) for v, _ in best]), np.array([t.decode() for t in kept], object)[np.concatenate([t for _, t in best])] if len(kept) else [], np.concatenate([v for v, _ in best])]
    out = [np.concatenate((np.asarray(x, object), np.asarray(y, object))) for x, y in zip(pair, term, strict=True)]
    part = ["pair"] * len(left) + ["term"] * len(term[2])
    return pa.table([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), *(pa.array(list(x), k) for x, k in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True))], names=["lang", "part", "source", "item", "value"])


def audited(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to all other sources, and up to top terms, of each group."""
    spark = docs.sparkSession
    with temporary(spark):
        counts = shared_table(term_counts(docs), "divergence-counts")
        parts = max(1, math.ceil(counts.count() / ROWS))
        rows = shared_table(coded(counts, least, parts), "divergence-terms")
        totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        kept = rows.groupBy("lang").agg(F.count_if("opens").alias("kept"))
        groups = docs.select(filled("lang"), filled("source")).distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        groups = shared_table(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "divergence-groups")
        # a language without kept terms has one chunk without rows
        chunks = rows.select("lang", "chunk").distinct().unionByName(groups.filter("kept = 0").select("lang", F.lit(-1).cast("long").alias("chunk")).distinct())
        each = shared_table(groups.join(chunks, "lang"), "divergence-chunks")
        found = rows.groupBy("lang", "chunk").cogroup(each.groupBy("lang", "chunk")).applyInArrow(compared, FOUND)
        found = shared_table(found, "divergence-found", outer=1)
    pairs = found.filter("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
