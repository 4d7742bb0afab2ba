"""A stored inverted index in blocks with bounds of their weights, and top-k search that skips blocks.

A task takes its documents in segments of about SEGMENT postings, orders those of a segment by the least
hash of their terms, which puts alike texts together, and cuts them into slabs of SLAB.  A block holds
what one slab has of one term: its postings, and the greatest frequency and least length among them,
which bound their weights whatever the corpus' statistics are.  A segment's blocks are written in the
order of (term, slab), so pages without an asked term are skipped in every segment, and a frequent term
is no task's alone.  Texts are split once, and building moves no posting to another task and sorts no
more than a segment.

A search first reads the blocks' bounds of the asked terms only, not their postings.  They bound what
any document of a slab can score.  The slabs of the highest bounds are scored, which gives each query a
score that a further document has to reach, and then only slabs whose bound reaches it.  The result is
the exact one.

An index is written below a path once and opened from there; build() puts its figures last, so a half
written index can't be opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators import search
from lodestone.operators.tables import new_folder, stored

SLAB = 512  # documents
SEGMENT = 1 << 20  # postings that a task orders at once
SENT = 1 << 15  # blocks of one Arrow batch
PUSHED = 200  # asked terms that are compared at the scan
ROUNDING = 1e-6  # scores are compared rounded

FIGURES = "n_docs long, total_length long, avgdl double"


@dataclass
class Index:
    """terms (term, df, idf, avgdl), blocks (term, slab, n, tf, dl, ids, tfs, dls) and figures of a written index.

    tf is a block's greatest frequency, dl its least length; ids, tfs and dls are its postings.
    """

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks").filter(F.col("term").isNotNull())

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def figures(self) -> DataFrame:
        return self.spark.read.schema(FIGURES).parquet(f"{self.path}/figures")

    @property
    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/figures/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)


def segments(batch: pa.RecordBatch, slab: int) -> Iterator[pa.RecordBatch]:
    """A batch of documents (id, dl, terms, alike), cut where the postings pass SEGMENT; a document is never cut."""
    upto, at = np.cumsum(np.asarray(batch.column(2).value_lengths())), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SEGMENT, "right")))
        if at + slab < stop < batch.num_rows:
            stop -= (stop - at) % slab
        yield batch.slice(at, stop - at)
        at = stop


def in_blocks(counted: DataFrame, slab: int) -> DataFrame:
    """The blocks of documents (id, dl, terms, alike), each segment's by term and slab, and for each segment a row without a term that holds the number (n) and length of its documents."""
    kind = counted.schema["id"].dataType
    key = to_arrow_type(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in (own for whole in batches for own in segments(whole, slab)):
            lists, dl = batch.column(2), batch.column(1).to_numpy()
            place, many = np.empty(batch.num_rows, np.int64), -(-batch.num_rows // slab)
            place[np.argsort(batch.column(3).fill_null(0).to_numpy(), kind="stable")] = np.arange(batch.num_rows)
            flat = lists.flatten()
            names, tf = flat.field("term").dictionary_encode(), flat.field("tf").to_numpy()
            named = pc.sort_indices(names.dictionary).to_numpy()
            rank = np.empty(len(named), np.int64)
            rank[named] = np.arange(len(named))
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.asarray(lists.value_lengths()))
            group = rank[names.indices.to_numpy()] * many + place[doc] // slab
            order = np.argsort(group, kind="stable")
            group, doc, tf = group[order], doc[order], tf[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(group)), bool), group[1:] != group[:-1])))
            for at in range(0, len(first), SENT):
                own = slice(first[at], first[at + SENT] if at + SENT < len(first) else len(group))
                begin, of = first[at : at + SENT] - own.start, group[first[at : at + SENT]]
                ends = np.append(begin, own.stop - own.start).astype(np.int32)
                long = dl[doc[own]].astype(np.int32)
                columns = [names.dictionary.take(pa.array(named[of // many])), pa.array(number + of % many), pa.array(np.diff(ends).astype(np.int64)), pa.array(np.maximum.reduceat(tf[own], begin)), pa.array(np.minimum.reduceat(long, begin))]
                postings = [batch.column(0).take(pa.array(doc[own])), pa.array(tf[own]), pa.array(long)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(pa.array(ends), p) for p in postings), pa.nulls(len(begin), pa.int64())], names=BLOCK)
            none = [pa.nulls(1, k) for k in (pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([batch.num_rows]), *(pa.nulls(1, pa.int32()) for _ in "td"), pa.nulls(1, pa.list_(key)), *(pa.nulls(1, pa.list_(pa.int32())) for _ in "td"), pa.array([int(dl.sum())])], names=BLOCK)
            number += many

    return counted.mapInArrow(work, f"term string, slab long, n long, tf int, dl int, ids array<{kind.simpleString()}>, tfs array<int>, dls array<int>, length long")


BLOCK = ["term", "slab", "n", "tf", "dl", "ids", "tfs", "dls", "length"]


def build(docs: DataFrame, path: str, slab: int = SLAB) -> Index:
    """The index of docs (id, text), written below path.

    A null id stands for no document.  Rows of one id are documents of their own; search sums them up.
    """
    spark = docs.sparkSession
    counted = search.counted(docs.filter(F.col("id").isNotNull()))
    alike = F.array_min(F.transform("terms", lambda t: F.xxhash64(t["term"])))
    in_blocks(counted.select("id", F.col("dl").cast("int").alias("dl"), "terms", alike.alias("alike")), slab).write.mode("overwrite").parquet(f"{path}/blocks")
    rows = spark.read.parquet(f"{path}/blocks")
    figures = rows.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))
    figures = stored(figures.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_length") / F.col("n_docs"))), "figures")
    df = rows.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    known = df.join(F.broadcast(figures.select("n_docs", "avgdl"))).select("term", "df", search.idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    known.write.mode("overwrite").parquet(f"{path}/terms")
    figures.write.mode("overwrite").parquet(f"{path}/figures")
    return Index(spark, path)


def postings(blocks: DataFrame, *more: str) -> DataFrame:
    """(id, tf, dl) of blocks, with more columns of theirs."""
    zipped = F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")
    return blocks.select(*more, zipped).select(*more, F.col("p.ids").alias("id"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"))


_kept: dict[tuple[str, str], Index] = {}


def state_of(spark: SparkSession, path: str) -> str:
    """A number that changes with the names, sizes and times of the files of a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return f"{files.agg(F.sum(F.xxhash64('path', 'length', 'modificationTime').cast('decimal(38,0)'))).first()[0]}"


def kept(spark: SparkSession, path: str, docs: DataFrame) -> Index:
    """The index of docs, which come from the table at path: built when first asked for, and again when the table's files have changed."""
    key = (f"{spark.sparkContext.applicationId} {path}", state_of(spark, path))
    if key not in _kept:
        _kept[key] = build(docs, new_folder(spark, "inverted"))
    return _kept[key]


@dataclass
class Asked:
    """The weighed terms of queries (query_id, term, idf, avgdl, q), a filter of blocks for the scan, and how to join what has no more rows than those."""

    terms: DataFrame
    at_scan: Column
    send: Callable[[DataFrame], DataFrame]


def asked(index: Index, queries: DataFrame, weighed: bool = True) -> Asked:
    """Of queries (query_id, text) the terms that the index has; q is their weight, or 1.

    While there are few different terms they are compared at the scan, so files and pages without them are skipped.
    """
    own = search.asked_terms(queries)
    names = [r["term"] for r in own.select("term").distinct().limit(PUSHED + 1).collect()]
    at_scan = F.lit(True) if len(names) > PUSHED else reduce(lambda a, b: a | b, (F.col("term") == t for t in names), F.lit(False))
    send = F.broadcast if own.count() <= search.SENT else lambda df: df
    q = search.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf")) if weighed else F.lit(1.0)
    known = index.terms.filter(at_scan).join(send(own), "term")
    return Asked(stored(known.select("query_id", "term", "idf", "avgdl", q.alias("q")), "asked-terms"), at_scan, send)


def bounds(index: Index, mine: Asked) -> DataFrame:
    """(query_id, slab, bound, blocks): what documents of a slab can score at most, from the blocks' bounds."""
    heads = index.blocks.select("term", "slab", "tf", "dl").filter(mine.at_scan).join(mine.send(mine.terms), "term")
    most = search.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))
    return stored(heads.groupBy("query_id", "slab").agg(F.sum(most * F.col("q")).alias("bound"), F.count("*").alias("blocks")), "bounds")


def scored(index: Index, mine: Asked, slabs: DataFrame) -> DataFrame:
    """(query_id, id, score) of all documents of stored slabs (query_id, slab) with a term asked for."""
    wanted = search.small(slabs.select("query_id", "slab"))
    blocks = index.blocks.filter(mine.at_scan).join(mine.send(mine.terms), "term").join(wanted, ["query_id", "slab"])
    rows = postings(blocks, "query_id", "idf", "avgdl", "q")
    w = search.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(w * F.col("q")), search.DIGITS).alias("score"))


def top(index: Index, queries: DataFrame, most: int, weighed: bool = True, first: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best documents of each query, by the product of BM25 weights, or by the documents' weights only."""
    return searched(index, queries, most, weighed, first)[0]


def searched(index: Index, queries: DataFrame, most: int, weighed: bool = True, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """top(), and for each query (query_id, blocks, read): blocks of its terms, and of how many the postings were read."""
    mine = asked(index, queries, weighed)
    bound = bounds(index, mine)
    # each of these slabs has one document at least, so by default there are enough to set the bar
    start = stored(search.best(bound, first or most, "query_id", score="bound", key="slab"), "first-slabs")
    hits = stored(scored(index, mine, start), "first-hits")
    bar = search.best(hits, most, "query_id").groupBy("query_id").agg(F.when(F.count("*") == most, F.min("score")).otherwise(0.0).alias("bar"))
    reach = bound.join(mine.send(bar), "query_id").filter(F.col("bound") >= F.col("bar") - F.lit(ROUNDING))
    begun = search.small(start.select("query_id", "slab"))
    rest = stored(reach.join(begun, ["query_id", "slab"], "left_anti").select("query_id", "slab", "blocks"), "more-slabs")
    best = search.best(hits.unionByName(scored(index, mine, rest)), most, "query_id")
    read = start.select("query_id", "blocks").unionByName(rest.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("read"))
    return best, bound.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id")
