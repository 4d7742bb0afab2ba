"""N-gram Jaccard join: all links between documents whose word n-gram sets are similar enough.

Exact, in these steps; a set is a sorted array of 64-bit n-gram hashes, and equal sets are one class:

1. Classes.  Each document's set gives n, its size, and a 64-bit class number.
2. Shared n-grams.  Sets are dealt by ranges of hashes; of an n-gram in one class only nothing is
   heard again, others come back to their classes with their document frequency.  A class of which
   less than the threshold's share is shared can have no link and is done: mostly that's nearly all.
3. Index.  The rest are indexed by the prefix that any link must meet: their rarest shared n-grams,
   all but so many that the others could not make up the overlap.  Each list is sorted by set size and
   cut into blocks where sizes are too far apart to link, so whole blocks are skipped by position;
   neighbours within a block are joined into candidate clusters.
4. Answers.  Within a cluster lists are entered and left by position, and answers are derived from
   those of pivots (cluster_links.py).

An n-gram in more than about DEAL sets, as a sample of all texts shows, isn't gathered to be counted: it is
known to be shared, counts as the most frequent, and its sets are dealt by class.  Of the sets of one
n-gram that a task indexes, so many go to the n-gram's list that sizes between them have no gap; the
others are tied to them in a list of that task.

A cluster of more than PART n-grams is never in one task: it is dealt by the least of its sets'
n-gram hashes, which similar sets mostly share, and what is solved apart goes on as components; after
ROUNDS such rounds its spans of near sizes that still hold different components are solved, in pairs of
parts where they are too large (unsettled()).

Defined cases: texts without words, or null, have the empty set, link with nothing and are their own
component; fewer than n words make one n-gram of all; repeated rows fall into one class; rows with a
null doc_id take part, but a component's id is the smallest that isn't null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.batches import LOWER, Texts, grams, hashes, mixed, pieces, words
from lodestone.llm.cluster_links import need, solved
from lodestone.llm.components import components
from lodestone.llm.shared import shared_table, temporary

WORDS = 5
PERCENT = 75
CLUSTER = 4_000_000  # n-grams of one group of sets that one task ever takes
PAIRED = 1_000_000  # of two parts of a large cluster that are solved together
PART = 100_000  # n-grams of a cluster that one task takes; larger clusters are dealt over several
SAMPLE = 64  # one text in so many shows which n-grams are too frequent for one task
HEAVY = 0xFFFFFFFF  # the document frequency given to those
SENT = 1_000_000  # rows of two numbers that are broadcast
FLUSH = 1 << 18  # n-grams that a task gathers before it deals them
DEAL = 1_000_000  # n-grams, 20 bytes each, that a task takes of those dealt by hash
MOST_PARTS = 100_000  # tasks that they are dealt to; beyond, tasks grow
ROUNDS = 2


def sets(texts: Texts, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-gram hashes, sorted, and where each text's begin."""
    low = Texts(texts.first, LOWER[texts.data], texts.bounds)
    starts, ends = words(low)
    h, bounds = hashes(low.data, starts, ends), low.counts(starts)
    g, g_bounds = grams(h, bounds, words_each)
    size = np.diff(bounds)
    for i in np.flatnonzero((size > 0) & (size < words_each)):  # few: texts of so few words
        short, _ = grams(h[bounds[i] : bounds[i + 1]], np.array([0, size[i]]), int(size[i]))
        if size[i] == 1:
            short = mixed(short)
        g = np.insert(g, g_bounds[i], short)
        g_bounds[i + 1 :] += 1
    out, ends = [], [0]
    for i in range(texts.n):
        own = np.unique(g[g_bounds[i] : g_bounds[i + 1]])
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(out) if out else g, np.array(ends)


def class_numbers(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, the same for equal sets."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ np.uint64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64)))
    return mixed((total[bounds[1:]] - total[bounds[:-1]]) + mixed(np.diff(bounds).astype(np.uint64))).astype(np.int64)


def classes(docs: DataFrame, words_each: int) -> DataFrame:
    """(doc_id, n, cls) of every row; cls is null for the empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                tokens, bounds = sets(texts, words_each)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), pa.array(n.astype(np.int64)), pa.array(class_numbers(tokens, bounds), mask=n == 0)], names=["doc_id", "n", "cls"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n long, cls long")


# ---------------------------------------------------------------- dealing packed columns

DEALT = "part int, blob binary"


def ranges(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of hashes that each falls in."""
    return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def packed(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows dealt to parts, each part's as one blob of columns."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    columns = [c[order] for c in columns]
    blobs = [b"".join([np.uint64(b - a).tobytes(), *(c[a:b].tobytes() for c in columns)]) for a, b in zip(first, np.append(first[1:], len(part)), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(blobs, pa.binary())], names=["part", "blob"])


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> list[np.ndarray]:
    """All rows of a partition's blobs, which are read where Arrow has them."""
    found: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for batch in batches:
        for blob in (x.as_buffer() for x in batch.column(1)):
            n, at = int(np.frombuffer(blob, np.uint64, 1)[0]), 8
            for k, kind in enumerate(kinds):
                found[k].append(np.frombuffer(blob, kind, n, at))
                at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in found]


def dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("part"))


def frequent(docs: DataFrame, words_each: int, share: int, most: int) -> np.ndarray:
    """N-grams (sorted hashes) that stand in more than about most different sets, by one text in share.

    There are at most as many as most goes into all n-grams.  Repeated texts are counted once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(0)):
                tokens, bounds = sets(texts, words_each)
                number = class_numbers(tokens, bounds)
                _, first = np.unique(number, return_index=True)
                chosen = np.zeros(texts.n, bool)
                chosen[first] = True
                own, n = np.unique(tokens[np.repeat(chosen, np.diff(bounds))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    some = docs.select("text", F.xxhash64("text").alias("h")).filter(F.pmod("h", F.lit(share)) == 0).dropDuplicates(["h"]).select("text")
    counts = some.mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(counts.filter(F.col("n") * share > most).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def among(tokens: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which tokens are among some sorted ones."""
    if not len(some):
        return np.zeros(len(tokens), bool)
    return some[np.minimum(np.searchsorted(some, tokens), len(some) - 1)] == tokens


def thinned(token: np.ndarray, number: np.ndarray, n: np.ndarray, percent: int) -> list[np.ndarray]:
    """Rows (token, number, n) of one task's index with the same components, few of them of any one token.

    Neighbouring sizes of a token that may link make a run.  Of a long run, the first and the last of
    every span of sizes that may link stay with the token; all are tied in a list of the run's own.
    """
    order = np.lexsort((number, n, token))
    token, number, n = token[order], number[order], n[order]
    size = n.astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    long = (np.diff(np.append(first, len(token))) > 8)[run] if len(first) else np.zeros(0, bool)
    span = np.floor(np.log(np.maximum(size, 1)) / np.log(100 / percent))
    edge = np.ones(len(token), bool)
    edge[1:] = new[1:] | (span[1:] != span[:-1])
    last = np.append(edge[1:], True) if len(edge) else edge
    own = mixed(token ^ mixed(number[first].view(np.uint64))[run]) if len(first) else token
    stay = ~long | edge | last
    return [np.concatenate(x) for x in ((token[stay], own[long]), (number[stay], number[long]), (n[stay], n[long]))]


def shared(docs: DataFrame, words_each: int, percent: int, parts: int, heavy: np.ndarray) -> DataFrame:
    """(cls, n, tokens): classes that share enough n-grams, and these, rarest first, as packed hashes; heavy: see frequent()."""
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def dealt_out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, number, _ = columns
        yield from packed(np.where(among(token, known.value), ranges(mixed(number.view(np.uint64)), parts), ranges(token, parts)), columns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for texts in pieces(batch.column(0)):
                tokens, bounds = sets(texts, words_each)
                number, n = class_numbers(tokens, bounds), np.diff(bounds)
                new = np.zeros(texts.n, bool)
                for i, c in enumerate(number.tolist()):
                    if n[i] and c not in seen:
                        seen.add(c)
                        new[i] = True
                mine = np.repeat(new, n)
                held.append((tokens[mine], np.repeat(number, n)[mine], np.repeat(n, n)[mine].astype(np.uint32)))
                size += len(held[-1][0])
                if size >= FLUSH:
                    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield from dealt_out(columns)
                    held, size = [], 0
        if held:
            yield from dealt_out([np.concatenate(x) for x in zip(*held, strict=True)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, number, n = unpacked(batches, [np.uint64, np.int64, np.uint32])
        often = among(token, known.value)
        if often.any():
            yield from packed(ranges(mixed(number[often].view(np.uint64)), parts), [number[often], n[often], np.full(int(often.sum()), HEAVY, np.uint32), token[often]])
            token, number, n = token[~often], number[~often], n[~often]
        order = np.argsort(token)
        ordered = token[order]
        same = ordered[1:] == ordered[:-1]
        del ordered
        twice = np.zeros(len(token), bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        order = order[np.lexsort((number[order], token[order]))]
        token, number, n = token[order], number[order], n[order]
        # a class may come from several tasks
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (number[1:] != number[:-1])
        token, number, n = token[once], number[once], n[once]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(token)), bool), token[1:] != token[:-1])))
        df = np.diff(np.append(first, len(token)))
        df = np.repeat(df, df).astype(np.uint32)
        order = np.flatnonzero(df > 1)
        order = order[np.argsort(number[order], kind="stable")]
        yield from packed(ranges(mixed(number[order].view(np.uint64)), parts), [number[order], n[order], df[order], token[order]])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, df, token = unpacked(batches, [np.int64, np.uint32, np.uint32, np.uint64])
        order = np.lexsort((token, df, number))
        number, n, token = number[order], n[order], token[order]
        once = np.ones(len(number), bool)  # a class with a frequent n-gram may come from several tasks
        once[1:] = (number[1:] != number[:-1]) | (token[1:] != token[:-1])
        number, n, token = number[once], n[once], token[once]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(number)), bool), number[1:] != number[:-1])))
        held = np.diff(np.append(first, len(number)))
        enough = np.flatnonzero(held >= need(n[first].astype(np.int64), percent))
        for at in range(0, len(enough), 512):
            some = enough[at : at + 512]
            blobs = [token[first[i] : first[i] + held[i]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(number[first[some]]), pa.array(n[first[some]].astype(np.int64)), pa.array(blobs, pa.binary())], names=["cls", "n", "tokens"])

    back = dealt(dealt(docs.select("text").mapInArrow(deal, DEALT), parts).mapInArrow(count, DEALT), parts)
    return back.mapInArrow(keep, "cls long, n long, tokens binary")


# ---------------------------------------------------------------- index and clusters


def prefix(tokens: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Those of a set's shared n-grams, rarest first, one of which any link has in common."""
    return tokens[: max(0, len(tokens) - int(need(np.int64(n), percent)) + 1)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edges with the same components: each node and the smallest of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (again := new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
        del again
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def clusters(table: DataFrame, percent: int, parts: int) -> DataFrame:
    """Edges (a, b) whose components hold all links; from the blocks of the index lists."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, number, size = [], [], []
            for c, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = prefix(np.frombuffer(blob, np.uint64), n, percent)
                token.append(own)
                number.append(np.full(len(own), c, np.int64))
                size.append(np.full(len(own), n, np.uint32))
            if token:
                columns = thinned(*[np.concatenate(x) for x in (token, number, size)], percent)
                yield from packed(ranges(columns[0], parts), columns)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, number, n = unpacked(batches, [np.uint64, np.int64, np.uint32])
        order = np.lexsort((number, n, token))
        token, number, n = token[order], number[order], n[order].astype(np.int64)
        # sizes ascend within a list; where the next is too large, a new block begins
        near = np.flatnonzero((token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]))
        a, b = forest(number[near], number[near + 1])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt(table.select("cls", "n", "tokens").mapInArrow(deal, DEALT), parts).mapInArrow(chain, "a long, b long")


def answers(grouped: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(cls, root) for the sets of each group."""

    def work(table: pa.Table) -> pa.Table:
        number, n = table["cls"].to_numpy(), table["n"].to_numpy()
        order = np.lexsort((number, n))
        blobs = table["tokens"].to_pylist()
        root = solved(n[order], [np.frombuffer(blobs[i], np.uint64) for i in order], percent)
        return pa.table({"cls": number[order], "root": number[order][root]})

    return grouped.groupBy(*keys).applyInArrow(work, "cls long, root long")


def in_parts(weighed: DataFrame, keys: list[str], most: int, seed: int) -> DataFrame:
    """weighed (with columns cls and n_held) with column part: groups of over most n-grams are dealt over several."""
    heavy = weighed.groupBy(*keys).agg(F.ceil(F.sum("n_held") / most).alias("parts")).filter("parts > 1")
    heavy = shared_table(heavy, "heavy-groups")
    both = weighed.join(F.broadcast(heavy) if heavy.count() <= SENT else heavy, keys, "left")
    return both.withColumn("part", F.coalesce(F.pmod(F.xxhash64("cls", F.lit(seed)), "parts"), F.lit(0)))


def round_of(table: DataFrame, seed: int, percent: int, most: int) -> DataFrame:
    """(cls, root): sets (cls, n, tokens, cluster) solved by groups of one cluster and least hash, or parts of such."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [int(mixed(np.frombuffer(b, np.uint64) ^ np.uint64(seed)).min().view(np.int64)) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], names=[*batch.schema.names, "least"])

    keyed = table.select("cls", "n", "tokens", "cluster").mapInArrow(least, "cls long, n long, tokens binary, cluster long, least long")
    keyed = shared_table(keyed.withColumn("n_held", F.length("tokens") / 8), "keyed-sets")
    return answers(in_parts(keyed, ["cluster", "least"], most, seed), ["cluster", "least", "part"], percent)


def unsettled(table: DataFrame, percent: int, most: int) -> DataFrame:
    """(cls, root) of links between sets (cls, n, tokens, cluster, label) of one cluster and different labels.

    Sets that link are near in size, so a cluster falls into spans of sizes, each set being in two of
    them, and any two that may link together in one.  Spans of a single label are done.  A span of more
    than most n-grams is cut into parts, and every two parts are solved together.
    """
    spans = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / math.log(100 / percent) + 1e-9)
    slim = table.select("cls", "cluster", "label", (F.length("tokens") / 8).alias("n_held"), F.explode(F.array(spans, spans - 1)).alias("span"))
    mixed_ = slim.groupBy("cluster", "span").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(2 * F.sum("n_held") / most).alias("parts")).filter("x <> y").select("cluster", "span", "parts")
    mixed_ = shared_table(mixed_, "large-spans")
    wanted = slim.join(F.broadcast(mixed_) if mixed_.count() <= SENT else mixed_, ["cluster", "span"]).withColumn("part", F.pmod(F.xxhash64("cls"), "parts"))
    # with k parts the pairs of one part with itself are left out, unless it is the only one
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("a"), F.greatest(i, F.col("part")).alias("b")))
    pair = F.explode(F.filter(other, lambda p: (p["a"] != p["b"]) | (F.col("parts") == 1))).alias("pair")
    groups = wanted.select("cls", "cluster", "span", pair).select("cls", "cluster", "span", "pair.a", "pair.b")
    return answers(groups.join(table.select("cls", "n", "tokens"), "cls"), ["cluster", "span", "a", "b"], percent).filter("cls <> root")


def roots(docs: DataFrame, words_each: int = WORDS, percent: int = PERCENT, cluster: int = CLUSTER, parts: int | None = None) -> DataFrame:
    """(cls, root) of the classes that have a link to another class; parts: of n-grams dealt by hash."""
    parts = max(parts or 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = shared_table(shared(docs, words_each, percent, parts, frequent(docs, words_each, SAMPLE, DEAL)), "shared-sets")
    near = components(clusters(table, percent, parts), "clusters")
    # two numbers for each clustered class: sent to the sets while few enough, or else dealt like them
    small_enough = near.count() <= SENT
    sized = table.join(F.broadcast(near) if small_enough else near, table["cls"] == near["node"]).select("cls", "n", "tokens", F.col("root").alias("cluster"))
    weight = sized.groupBy("cluster").agg(F.sum(F.length("tokens") / 8).alias("held"))
    part = min(cluster, PART)
    large = shared_table(weight.filter(F.col("held") > part).select("cluster"), "large-clusters")
    if not large.limit(1).count():
        return answers(sized, ["cluster"], percent)
    sized = shared_table(sized, "clustered-sets")
    small = answers(sized.join(large, "cluster", "left_anti"), ["cluster"], percent)
    whole = shared_table(sized.join(large, "cluster", "left_semi").select("cls", "n", "tokens", "cluster"), "large-sets")
    heads, ties = whole, []
    for seed in range(1, ROUNDS + 1):  # the first sets of the components so far are dealt anew
        tied = shared_table(round_of(heads, seed, percent, part), "large-round")
        ties.append(tied.filter("cls <> root"))
        heads = shared_table(heads.join(tied.filter("cls = root").select("cls"), "cls", "left_semi"), "large-heads")
    links = reduce(DataFrame.unionByName, ties).select(F.col("cls").alias("a"), F.col("root").alias("b"))
    met = components(links, "large-met")
    labelled = whole.join(met, whole["cls"] == met["node"], "left").select("cls", "n", "tokens", "cluster", F.coalesce("root", "cls").alias("label"))
    late = unsettled(shared_table(labelled, "large-labelled"), percent, min(cluster, PAIRED))
    links = met.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    return small.unionByName(components(links, "large-links").select(F.col("node").alias("cls"), "root"))


def linked(docs: DataFrame, words_each: int = WORDS, percent: int = PERCENT, cluster: int = CLUSTER) -> DataFrame:
    """(doc_id, n_shingles, component_id, cls, root) for every row of docs; root numbers the component."""
    rows = shared_table(classes(docs, words_each), "set-classes")
    heads = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("head"))
    held = rows.dropDuplicates(["cls"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    with temporary(docs.sparkSession):
        root = roots(docs, words_each, percent, cluster, min(-(-held // DEAL), MOST_PARTS))
        named = heads.join(root, "cls", "left").select("cls", "head", F.coalesce("root", "cls").alias("root"))
        named = shared_table(named, "class-roots", outer=1)
    first = named.groupBy("root").agg(F.min("head").alias("component_id"))
    of_class = named.join(first, "root").select(F.col("cls").alias("c"), "component_id", "root")
    return rows.join(of_class, F.col("cls") == F.col("c"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "cls", "root")


def with_class(docs: DataFrame, name: str, words_each: int) -> DataFrame:
    """docs with each row's class number as one more column."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(at)):
                tokens, bounds = sets(texts, words_each)
                own = batch.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(class_numbers(tokens, bounds), mask=np.diff(bounds) == 0)], names=[*own.schema.names, name])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame, words_each: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id; columns as they were.

    Rows whose doc_id is null or stands in several rows are told apart by their class, so each component
    keeps one row, also if it has no id or shares it with others.  Of those with the empty set, which
    are their own components, one row of each doc_id and text stays.
    """
    rows = shared_table(linked(docs, words_each, percent), "linked")
    lead = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    many = rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("many_id"))
    many = shared_table(many, "repeated-ids")
    own = docs["doc_id"].cast("long")
    plain = lead.filter("doc_id is not null").select(F.col("doc_id").alias("kept_id")).join(many, F.col("kept_id") == F.col("many_id"), "left_anti")
    stay = docs.join(plain, own == plain["kept_id"], "left_semi")
    if not many.limit(1).count() and not rows.filter("doc_id is null").limit(1).count():
        return stay
    tag = "_".join(["class", *docs.columns])  # no column of docs can be called so
    odd = docs.join(many, own == many["many_id"], "left_semi").unionByName(docs.filter(own.isNull()))
    odd = with_class(odd, tag, words_each).withColumn(f"{tag}_text", F.when(F.col(tag).isNull(), F.md5("text")))
    odd = odd.dropDuplicates(["doc_id", tag, f"{tag}_text"])
    heads = lead.filter("cls is not null").groupBy("root").agg(F.min("doc_id").alias("head_id"), F.min("cls").alias("head_cls"))
    heads = heads.select("head_id", "head_cls")
    first = odd.join(heads, (odd[tag] == heads["head_cls"]) & odd["doc_id"].cast("long").eqNullSafe(heads["head_id"]), "left_semi")
    return stay.unionByName(first.unionByName(odd.filter(odd[tag].isNull())).select(*docs.columns))
