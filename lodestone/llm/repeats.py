"""Removal of long passages that stand earlier in the corpus, by run-length indexes.

Every byte covered by LENGTH bytes that also start earlier goes.  Earlier is a smaller doc_id, or an
earlier start in the same document.  Exact, in these steps:

1. Pieces.  In each window of LENGTH bytes the GRAM bytes of least hash are its anchor, so equal windows
   have equal anchors.  Neighbouring windows with one anchor are a piece.  Pieces are dealt by anchor;
   of equal pieces all but the earliest are marked, within a task before anything is dealt out.
2. Candidates.  A window holds SIDE more bytes before its anchor or behind it.  Different pieces that
   agree in an anchor and in one of these sides can share a window; all others are done.  What is known
   goes to the documents, and those without candidates are finished.
3. Matches.  Candidates meet by anchor and side, with the windows that hold that side.  Earlier ones are put into a run-length index (run_index),
   the later ones' matching statistics are streamed against it, and matches of LENGTH bytes or more are
   marked; a group is halved again and again, so every piece is streamed against all earlier ones.
4. Marks of each document are joined to its text, which is cut.

Anchors that a sample of one text in SAMPLE shows in more than about HOT different pieces are dealt by
anchor and side; of a group of more than MANY candidates each window is a piece of its own.  So no
group of any size meets in one task.

Pieces are told apart by 64-bit hashes of their own beside the anchor's.

Defined cases: null text is empty; texts of fewer than LENGTH bytes lose nothing; a null doc_id stands
behind all others; different texts of one doc_id are different documents in the order of a hash of their
text, equal rows are one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import mixed, pieces, powers
from lodestone.llm.ngram_join import among, dealt, ranges
from lodestone.llm.run_index import RunIndex
from lodestone.llm.shared import shared_table, temporary

LENGTH = 100
GRAM = 24
SIDE = (LENGTH - GRAM) // 2
SPAN = LENGTH - GRAM + 1  # places of an anchor in a window
BLOCK = 1 << 18  # bytes of texts worked on at once
FLUSH = 1 << 17  # pieces that a task gathers before it deals them
PART = 8 << 20  # bytes of text whose pieces are dealt to one task
SAMPLE = 64
HOT = 500_000
MANY = 64
BUCKET = 1 << 20  # bytes of candidates that are indexed and streamed together
LAST = (1 << 63) - 1

_TIMES = np.random.default_rng(20240913).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64((1 << 20) - 1)

PIECES = [np.uint64, np.uint64, np.uint32, np.uint32, np.int64, np.int64, np.uint32, np.uint8, np.uint8]  # anchor, piece, before, behind, id, th, start, windows, those with enough before the anchor
MARKS = [np.int64, np.int64, np.uint32, np.uint32]  # id, th, start, windows
FOUND = "id long, th long, start long, n long, grp long, rank int, size int"


# ---------------------------------------------------------------- pieces of texts


class Sums:
    """Hashes of spans of at least 8 bytes, from running sums over mixed runs of eight bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        eight = np.empty(len(data), np.uint64)
        for k in range(8):
            own = eight[k::8]
            own[:] = padded[k : k + (len(data) + 8) // 8 * 8].view("<u8")[: len(own)]
        self.value = mixed(eight ^ np.uint64(0x9E3779B97F4A7C15))
        up, self.down = powers(len(data) + 1)
        self.upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value * up[: len(data)])))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.upto[end - 7] - self.upto[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self) -> np.ndarray:
        """Of GRAM bytes from each position on."""
        n = max(0, len(self.value) - GRAM + 1)
        return mixed(sum((self.value[k : k + n] * t for k, t in zip(range(0, GRAM, 8), _TIMES, strict=False)), np.zeros(n, np.uint64)))


def cut(data: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of texts end to end: first window, number of windows, hashes of anchor, piece, and anchor with either side (0: none), and how many windows hold the side before."""
    many = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
    if not many.any():
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32, np.int64))
    sums = Sums(data)
    gram = sums.grams()
    # the least of SPAN neighbours: of two blocks, the rest of one and the beginning of the next; its place is in the key
    n = len(gram)
    key = np.full(-(-n // SPAN) * SPAN, np.uint64(2**64 - 1))
    key[:n] = (gram & ~PLACE) | np.arange(n, dtype=np.uint64)
    key = key.reshape(-1, SPAN)
    upto, rest = np.minimum.accumulate(key, 1).ravel(), np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(rest[: n - SPAN + 1], upto[SPAN - 1 : n]) & PLACE).astype(np.int64)
    out = np.concatenate(([0], np.cumsum(many)))
    window = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], many)
    anchor = anchor[window]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    start, anchor, windows = window[first], anchor[first], np.diff(np.append(first, len(window)))
    lead = np.clip(anchor - SIDE - start + 1, 0, windows)
    before, behind = lead > 0, lead < windows
    h, left, right = gram[anchor], np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    left[before] = sums.spans(anchor[before] - SIDE, anchor[before] + GRAM) | np.uint64(1)
    right[behind] = sums.spans(anchor[behind], anchor[behind] + GRAM + SIDE) | np.uint64(1)
    split = among(h, hot)
    if split.any():  # hot anchors: windows with enough before the anchor and the others are two pieces
        keep, parts = ~split, []
        for side, has, low, n in ((left, before, start, lead), (right, behind, start + lead, windows - lead)):
            own = split & has
            parts.append((low[own], n[own], mixed(h[own] ^ mixed(side[own])), np.ones(own.sum(), np.uint64), np.zeros(own.sum(), np.uint64), n[own]))
        start, windows, h, left, right, lead = (np.concatenate((x[keep], *(p[k] for p in parts))) for k, x in enumerate((start, windows, h, left, right, lead)))
    narrow = lambda x: (x >> np.uint64(32)).astype(np.uint32) | (x & np.uint64(1)).astype(np.uint32)
    return start, windows, h, sums.spans(start, start + windows + LENGTH - 1), narrow(left), narrow(right), lead


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, row of the batch and offset in its text, for pieces of work; a long text is cut so that each window is whole in one of them."""
    for texts in pieces(batch.column(column)):
        if len(texts.data) <= 2 * BLOCK:
            yield texts.data, texts.bounds, np.arange(texts.first, texts.first + texts.n), np.zeros(texts.n, np.int64)
            continue
        for k in range(texts.n):
            own = texts.data[texts.bounds[k] : texts.bounds[k + 1]]
            for at in range(0, max(1, len(own) - LENGTH + 1), BLOCK):
                part = own[at : at + BLOCK + LENGTH - 1]
                yield part, np.array([0, len(part)]), np.array([texts.first + k]), np.array([at])


def ordered(x: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pieces by anchor, hash and place; which of them are the earliest of equal ones, and which stand elsewhere than that."""
    order = np.lexsort((x[6], x[5], x[4], x[1], x[0]))
    x = [c[order] for c in x]
    first = np.ones(len(order), bool)
    first[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
    own = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order
    return x, first, (x[4] != x[4][own]) | (x[5] != x[5][own]) | (x[6] != x[6][own])


DEALT = "part int, blob binary, marks binary"


def sent(gathered: list[list[np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Gathered pieces, dealt by anchor: the earliest of equal ones, and marks of the others.

    An anchor is the least hash of its windows, so anchors are mixed before they are dealt by range.
    """
    x, first, again = ordered([np.concatenate(c) for c in zip(*gathered, strict=True)])
    for columns, key, other in (([c[first] for c in x], mixed(x[0][first]), False), ([x[4][again], x[5][again], x[6][again], x[7][again].astype(np.uint32)], mixed(x[4][again].view(np.uint64) ^ x[6][again]), True)):
        part = ranges(key, parts)
        if not len(part):
            continue
        order = np.argsort(part, kind="stable")
        part, columns = part[order], [c[order] for c in columns]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        blobs = pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(at, np.append(at[1:], len(part)), strict=True)], pa.binary())
        none = pa.nulls(len(blobs), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(part[at]), *((none, blobs) if other else (blobs, none))], names=["part", "blob", "marks"])


def unpacked(blobs: list[bytes | None], kinds: list[type]) -> list[np.ndarray]:
    """The columns of blobs, end to end."""
    width, found = sum(np.dtype(k).itemsize for k in kinds), [[np.zeros(0, k)] for k in kinds]
    for blob in (b for b in blobs if b):
        n, at = len(blob) // width, 0
        for k, kind in enumerate(kinds):
            found[k].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(f) for f in found]


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, id, th, text): id and th order documents; text as bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def frequent(rows: DataFrame, share: int, most: int) -> np.ndarray:
    """Anchors (sorted hashes) in more than about most different pieces, by one text in share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bounds, _, _ in blocks(batch, 0):
                _, _, h, u, *_ = cut(data, bounds, np.zeros(0, np.uint64))
                h, n = np.unique(np.unique(np.rec.fromarrays([h, u])).f0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    some = rows.filter(F.pmod("th", F.lit(share)) == 0).dropDuplicates(["th"]).select("text")
    counts = some.mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") * share > most)
    return np.sort(counts.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def pieces_of(rows: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast(hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, bounds, row, offset in blocks(batch, 2):
                start, windows, h, u, left, right, lead = cut(data, bounds, known.value)
                text = np.searchsorted(bounds, start, "right") - 1
                at = (start - bounds[text] + offset[text]).astype(np.uint32)
                held.append([h, u, left, right, ids[row[text]], th[row[text]], at, windows.astype(np.uint8), lead.astype(np.uint8)])
                n += len(start)
                if n >= FLUSH:
                    yield from sent(held, parts)
                    held, n = [], 0
        if n:
            yield from sent(held, parts)

    return rows.select("id", "th", "text").mapInArrow(work, DEALT)


def settled(sent_out: DataFrame, parts: int) -> DataFrame:
    """Marks (rank -1) and candidates of all pieces: FOUND, with the group that a candidate meets others in, its rank there and the group's size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, marks = [], []
        for batch in batches:
            blobs += batch.column(1).to_pylist()
            marks += batch.column(2).to_pylist()
        ids, th, start, windows = unpacked(marks, MARKS)
        yield found(ids, th, start, windows)
        x, first, again = ordered(unpacked(blobs, PIECES))
        yield found(*(x[k][again] for k in (4, 5, 6, 7)))
        h, _, left, right, ids, th, start, windows, lead = (c[first] for c in x)
        for side, salt, begin, n in ((left, 0x2545F491, start, lead), (right, 0x4F6CDD1D, start + lead, windows - lead)):
            own = np.flatnonzero(side)
            grp = mixed(h[own] ^ mixed(side[own].astype(np.uint64) << np.uint64(32) | np.uint64(salt)))
            order = np.lexsort((start[own], th[own], ids[own], grp))
            own, grp = own[order], grp[order]
            at = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1]))) if len(grp) else np.zeros(0, np.int64)
            size = np.repeat(np.diff(np.append(at, len(grp))), np.diff(np.append(at, len(grp))))
            rank = np.arange(len(grp)) - np.repeat(at, np.diff(np.append(at, len(grp))))
            some = size > 1
            own = own[some]
            yield found(ids[own], th[own], begin[own], n[own], grp[some].view(np.int64), rank[some], size[some])

    return dealt(sent_out, parts).mapInArrow(work, FOUND)


def found(ids: np.ndarray, th: np.ndarray, start: np.ndarray, windows: np.ndarray, *group: np.ndarray) -> pa.RecordBatch:
    grp, rank, size = group or (np.zeros(len(ids), np.int64), np.full(len(ids), -1), np.zeros(len(ids), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip((ids, th, start, windows, grp, rank, size), (*[np.int64] * 5, np.int32, np.int32), strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


# ---------------------------------------------------------------- candidates


def repeated(grp: np.ndarray, rank: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which bytes of pieces end to end begin length bytes that a piece of lower rank in the group has too.

    Groups are merged from pairs up: in each span of 2, 4, 8 ... ranks the first half is indexed and the
    second half streamed, so any two pieces of a group meet once.
    """
    out, width = np.zeros(len(data), bool), 1
    while width <= rank.max(initial=0):
        span, late = rank // (2 * width), rank // width % 2 == 1
        for k in range(int(span.max()) + 1):
            streamed = np.flatnonzero((span == k) & late)
            indexed = np.flatnonzero((span == k) & ~late & np.isin(grp, grp[streamed]))
            if len(streamed) and len(indexed):
                took, there = joined(data, bounds, streamed)
                own = RunIndex(*joined(data, bounds, indexed)[:1], *ends(bounds, indexed)).matching(took, *ends(bounds, streamed))
                out[there[own >= length]] = True
        width *= 2
    return out


def joined(data: np.ndarray, bounds: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some pieces, and where they stand in data."""
    size = np.diff(bounds)[some]
    at = np.arange(size.sum()) + np.repeat(bounds[some] - (np.cumsum(size) - size), size)
    return data[at], at


def ends(bounds: np.ndarray, some: np.ndarray) -> tuple[np.ndarray]:
    return (np.concatenate(([0], np.cumsum(np.diff(bounds)[some]))),)


def matched(candidates: DataFrame, parts: int) -> DataFrame:
    """Marks (id, th, start, n) of candidates (id, th, start, grp, rank, bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).sort_by([("grp", "ascending"), ("rank", "ascending")]).combine_chunks()
        ids, th, start, grp, rank = (rows.column(c).to_numpy() for c in ("id", "th", "start", "grp", "rank"))
        blobs = rows.column("bytes").to_pylist()
        upto = np.concatenate(([0], np.cumsum([len(b) for b in blobs])))
        new = np.append(np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1]))), len(grp))
        begin = 0
        while begin < len(grp):
            stop = int(new[max(np.searchsorted(new, begin, "right"), np.searchsorted(upto[new], upto[begin] + BUCKET, "right") - 1)])
            data, bounds = np.frombuffer(b"".join(blobs[begin:stop]), np.uint8), upto[begin : stop + 1] - upto[begin]
            at = np.flatnonzero(repeated(grp[begin:stop], rank[begin:stop], data, bounds))
            piece = np.searchsorted(bounds, at, "right") - 1
            # neighbours of one piece are one mark
            head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])))) if len(at) else at
            own = piece[head] + begin
            columns = [ids[own], th[own], start[own] + at[head] - bounds[piece[head]], np.diff(np.append(head, len(at)))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["id", "th", "start", "n"])
            begin = stop

    return candidates.repartition(parts, "grp").mapInArrow(work, "id long, th long, start long, n long")


def single_windows(candidates: DataFrame, parts: int) -> DataFrame:
    """Each window of candidates as a piece of its own, to be dealt by its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, th, start = (batch.column(c).to_numpy() for c in ("id", "th", "start"))
            blobs = batch.column("bytes").to_pylist()
            step = max(1, BLOCK // (2 * LENGTH + SPAN))
            for first in range(0, len(blobs), step):
                some = blobs[first : first + step]
                bounds = np.concatenate(([0], np.cumsum([len(b) for b in some])))
                sums = Sums(np.frombuffer(b"".join(some), np.uint8))
                many = np.diff(bounds) - LENGTH + 1
                piece = np.repeat(np.arange(len(some)), many)
                own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = bounds[piece] + own
                half = at + LENGTH // 2
                h, u = sums.spans(at, at + LENGTH), mixed(sums.spans(at, half) * _TIMES[3] + sums.spans(half, at + LENGTH))
                none = np.zeros(len(at), np.uint32)
                held.append([h, u, none, none, ids[first + piece], th[first + piece], (start[first + piece] + own).astype(np.uint32), np.ones(len(at), np.uint8), np.ones(len(at), np.uint8)])
                n += len(at)
                if n >= FLUSH:
                    yield from sent(held, parts)
                    held, n = [], 0
        if n:
            yield from sent(held, parts)

    return candidates.mapInArrow(work, DEALT)


# ---------------------------------------------------------------- documents

KEPT = "doc_id long, id long, th long, text string, marks array<struct<start:long,n:long>>, todo array<struct<start:long,n:long,grp:long,rank:int,size:int>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remaining(text: bytes, start: np.ndarray, windows: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text without the marked windows, and how many spans go."""
    if not len(start):
        return text, 0
    change = np.bincount(start, minlength=len(text) + 1) - np.bincount(start + windows + LENGTH - 1, minlength=len(text) + 1)
    gone = np.cumsum(change)[: len(text)] > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def digests(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with the digest columns filled in, those without a todo; they keep no text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("marks").cast(pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))
            flat, to = lists.flatten(), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            wait = np.asarray(batch.column("todo").value_lengths().fill_null(0)) > 0 if "todo" in batch.schema.names else np.zeros(batch.num_rows, bool)
            out = []
            for k, text in enumerate(batch.column("text")):
                data = text.as_py().encode()
                left, spans = (b"", 0) if wait[k] else remaining(data, start[to[k] : to[k + 1]], n[to[k] : to[k + 1]])
                out.append((None,) * 4 if wait[k] else (len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest()))
            filled = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            columns = {c: batch.column(c) for c in batch.schema.names} | dict(zip(RESULT[1:], filled, strict=True))
            if "todo" in columns:
                kept = pa.array(np.arange(batch.num_rows), mask=~wait)
                columns |= {c: columns[c].take(kept) for c in ("text", "marks", "todo")}
            names = [c.strip().split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return rows.mapInArrow(work, schema)


def cut_out(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs."""
    rows, spark = named(docs), docs.sparkSession
    with temporary(spark):
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, math.ceil(size / PART))
        all_found = shared_table(settled(pieces_of(rows, parts, frequent(rows, SAMPLE, HOT)), parts), "repeats-found")
        marks = F.collect_list(F.when(F.col("rank") < 0, F.struct("start", "n"))).alias("marks")
        todo = F.collect_list(F.when(F.col("rank") >= 0, F.struct("start", "n", "grp", "rank", "size"))).alias("todo")
        by_doc = all_found.groupBy("id", "th").agg(marks, todo)
        kept = shared_table(digests(rows.join(by_doc, ["id", "th"], "left").select("doc_id", "id", "th", "text", "marks", "todo"), KEPT), "repeats-kept", outer=1)
        waiting = kept.filter(F.col("text").isNotNull())
        one = waiting.select("id", "th", F.col("text").cast("binary").alias("text"), F.explode("todo").alias("c"))
        bytes_ = F.substring("text", F.col("c.start").cast("int") + 1, F.col("c.n").cast("int") + LENGTH - 1).alias("bytes")
        candidates = one.select("id", "th", "c.start", "c.n", "c.grp", "c.rank", "c.size", bytes_)
        few, many = F.col("size") <= MANY, F.col("size") > MANY
        n_few, n_many = all_found.filter(F.col("rank") >= 0).agg(F.sum(F.when(few, F.col("n") + LENGTH)), F.sum(F.when(many, F.col("n")))).first()
        more = matched(candidates.filter(few).drop("size"), max(1, math.ceil((n_few or 0) / (4 * BUCKET))))
        if n_many:
            apart = max(1, math.ceil(n_many / FLUSH))
            more = more.unionByName(settled(single_windows(candidates.filter(many), apart), apart).select("id", "th", "start", "n"))
        more = shared_table(more, "repeats-more")
        later = more.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("later"))
        waiting = waiting.select("doc_id", "id", "th", "text", "marks").join(later, ["id", "th"], "left")
        every = F.concat("marks", F.coalesce("later", F.array().cast("array<struct<start:long,n:long>>"))).alias("marks")
        last = digests(waiting.select("doc_id", "text", every), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        last = shared_table(last, "repeats-last", outer=1)
    return kept.filter(F.col("text").isNull()).select(*RESULT).unionByName(last)
