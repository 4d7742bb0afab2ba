"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter, footer.

Documents are dealt by ranges of their identifier; each range becomes one shard file, written by its
task in key order under a temporary name and renamed, so a task that runs again leaves the same file.
A shard is::

    block*      zstd; entries: shared prefix length, rest of the key, number of ids, crc32, ids
    index       for each block: first key, offset, length, entries
    bloom       bits of all identifiers
    footer      offsets of index and bloom, entries, ids, smallest and largest key, magic

Keys are 8 bytes: doc_id as a big-endian integer with the sign bit flipped, so bytes sort as numbers.
A null doc_id is the empty key and comes first.  A lookup reads footer, Bloom filter and index, finds
the one block that can hold the key by binary search, and scans that.

Encoding: the tokenizer works on parts of words (runs of letters, single digits, runs of other marks)
apart from each other and drops white space.  The texts of a piece are cut into parts at once, and each
distinct part is encoded once per worker and remembered (a bounded number); short ones are looked up all
at once.  Words with characters that
normalisation may change go through the whole tokenizer; so do texts with "<|", as special tokens are
found before words are, and all texts if the vocabulary has another normaliser or pre-tokenizer.

Defined cases: null text is empty and has only the end id; rows with the same doc_id are kept apart,
ordered by the hash of their text, equal rows in any order (they are equal); an empty table writes no
shards and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import LOWER, Texts, pieces, words
from lodestone.llm.shared import new_path

MAGIC = b"LSST0001"
FOOTER = struct.Struct("<QQQQQQBqq8s")
BLOCK_IDS = 1 << 14  # ids after which a block ends
BLOOM_BITS = 10  # for each key
REMEMBERED = 500_000  # parts of words whose ids a worker keeps
ENTRY = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------- encoding


# The normaliser and pre-tokenizer that spans() stands for; texts of other vocabularies are encoded whole.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True}
PARTED = {"type": "Sequence", "pretokenizers": [SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# Kinds of bytes.  Hard ones are of characters that may have other normal forms than their lower case.
WHITE, LETTER, DIGIT, OTHER, HARD, WHOLE = range(6)
LONGEST = 64  # bytes of a part that is remembered
TRIES = 4  # slots that a part may have in the table of short parts
FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # of the first n bytes of eight


def kind_of(char: str) -> int:
    easy = "\x21" <= char <= "\x7e" or "\xa1" <= char <= "\u017f" and char != "\u0130"
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(char)[0], OTHER) if easy else WHITE if char in " \t\n\x0b\f\r" else HARD


# Of single bytes, and of the pairs that are U+0080 to U+017F.
PAIRS = [chr(0x80 + i) for i in range(256)]
KIND = np.array([kind_of(chr(b)) if b < 128 else HARD for b in range(256)], np.uint8)
PAIR_KIND = np.array([kind_of(c) for c in PAIRS], np.uint8)
PAIR_LOWER = np.array([list((c if kind_of(c) == HARD else c.lower()).encode()) for c in PAIRS], np.uint8)


def inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Of n bytes, those in one of the spans."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def spans(texts: Texts, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and kinds of the parts as the pre-tokenizer cuts them, in lower case.

    A word with a hard byte is one part of kind WHOLE, and so is each of the whole texts, as they are.
    """
    n = len(texts.data)
    data = np.concatenate((texts.data, np.zeros(16, np.uint8)))
    kind, low = KIND[data], LOWER[data]
    kind[n:] = WHITE
    first = np.zeros(n + 1, bool)
    first[texts.bounds] = True
    lead = np.flatnonzero((data[:n] >= 0xC2) & (data[:n] <= 0xC5))
    lead = lead[(data[lead + 1] & 0xC0 == 0x80) & ~first[lead + 1]]
    pair = (data[lead] - 0xC2) * 64 + (data[lead + 1] & 0x3F)
    kind[lead] = kind[lead + 1] = PAIR_KIND[pair]
    low[lead], low[lead + 1] = PAIR_LOWER[pair].T
    hard = np.flatnonzero(kind[:n] == HARD)
    if len(hard):
        starts, ends = words(texts)
        held = np.unique(np.searchsorted(starts, hard, "right") - 1)
        kind[:n][inside(starts[held], ends[held], n)] = WHOLE
    if len(whole):
        kind[:n][inside(texts.bounds[whole], texts.bounds[whole + 1], n)] = WHOLE
    np.copyto(low, data, where=kind == WHOLE)
    cut = first | (kind[: n + 1] == DIGIT)
    cut[1:] |= kind[1 : n + 1] != kind[:n]
    cut[lead + 1] = False
    mark = np.flatnonzero(low[:n] == ord("'"))
    mark = mark[cut[mark] & cut[mark + 1] & ~first[mark + 1] & (kind[mark] == OTHER) & (kind[mark + 1] == LETTER)]
    one, two = low[mark + 1], low[mark + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    long &= ~cut[mark + 2]
    cut[mark[short | long] + 1] = False
    cut[mark[short] + 2] = cut[mark[long] + 3] = True
    at = np.flatnonzero(cut[:n])
    full = kind[at] != WHITE
    return low, at[full], np.append(at, n)[1:][full], kind[at[full]]


def byte_letters() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies: itself if printable."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = np.arange(256, dtype="<u4")
    out[hidden] = 256 + np.arange(len(hidden))
    return out


LETTERS = byte_letters()


id_of_token = attrgetter("id")


class Table:
    """Places of parts of up to 16 bytes, by their bytes as two numbers; looked up many at once.

    A part that finds none of its slots free isn't in it.
    """

    def __init__(self, most: int):
        self.bits = (2 * most).bit_length()
        self.keys = np.zeros((2, 1 << self.bits), np.uint64)
        self.places = np.full(1 << self.bits, -1, np.int64)

    @staticmethod
    def numbers(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Two numbers of each part, 0 if it can't be in a table; low has 16 bytes more than the parts."""
        eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
        size = ends - starts
        out = np.stack((eight[starts] & MASKS[np.minimum(size, 8)], eight[np.minimum(starts + 8, len(eight) - 1)] & MASKS[np.clip(size - 8, 0, 8)]))
        out[:, (size > 16) | (kinds == WHOLE)] = 0
        return out

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers[0] * FACTORS[0] + numbers[1] * FACTORS[1]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        out, left, slots = np.full(numbers.shape[1], -1), np.flatnonzero(numbers[0]), self.slots(numbers)
        for _ in range(TRIES):
            at = slots[left]
            same = (self.keys[0][at] == numbers[0][left]) & (self.keys[1][at] == numbers[1][left])
            out[left[same]] = self.places[at[same]]
            left = left[~same]
            slots[left] = (slots[left] + 1) % len(self.places)
        return out

    def enter(self, numbers: np.ndarray, places: np.ndarray) -> None:
        left, slots = np.flatnonzero(numbers[0]), self.slots(numbers)
        for _ in range(TRIES):
            free = left[self.places[slots[left]] < 0]
            self.places[slots[free]] = places[free]  # of several the last stays
            won = free[self.places[slots[free]] == places[free]]
            self.keys[:, slots[won]] = numbers[:, won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slots[left] = (slots[left] + 1) % len(self.places)


class Encoder:
    """Ids of whole texts, by way of remembered parts of words.

    Parts beyond the bound of the memory are encoded each time.  Parts go to the tokenizer's model, words
    with hard characters and whole texts through the whole tokenizer.
    """

    def __init__(self, vocabulary: str, end_id: int, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(vocabulary)
        self.model = t.model
        forms = [part and json.loads(part.__getstate__()) for part in (t.normalizer, t.pre_tokenizer)]
        special = all("<|" in token.content for token in t.get_added_tokens_decoder().values())
        self.cuts = forms == [NORMALISED, PARTED] and special and t.truncation is None and t.padding is None
        self.most = remembered or REMEMBERED
        self.place: dict[str, int] = {}  # by byte letters
        self.table = Table(self.most)
        self.ids = array("I", [end_id])
        self.begin = array("q", [0, 1])  # of each place, and after the last; place 0 is the end of a text

    def learn(self, new: dict[str, int], low: np.ndarray, numbers: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> list[str]:
        """Give the parts, each with where it is among all, places; those to forget again come last and are returned."""
        first = len(self.begin) - 1
        kept = [p for p in new if len(p) <= LONGEST][: max(0, self.most + 1 - first)]
        rest = list(new.keys() - set(kept)) if len(kept) < len(new) else []
        parts, ids, begin, tokenize = [*kept, *rest], self.ids, self.begin, self.model.tokenize
        at = np.fromiter(map(new.get, parts), np.int64, len(parts))
        for part, end, whole in zip(parts, ends[at].tolist(), (kinds[at] == WHOLE).tolist(), strict=True):
            if whole:
                text = low[end - len(part) : end].tobytes().decode("utf-8", "replace")
                ids.extend(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                ids.extend(map(id_of_token, tokenize(part)))
            begin.append(len(ids))
        self.place.update(zip(parts, range(first, first + len(parts)), strict=True))
        self.table.enter(numbers[:, at[: len(kept)]], np.arange(first, first + len(kept)))
        return rest

    def forget(self, last: list[str]) -> None:
        for part in last:
            del self.place[part]
        if last:
            del self.begin[-len(last) :]
            del self.ids[self.begin[-1] :]

    def encode_all(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each begin (n + 1 values)."""
        if self.cuts:  # special tokens are found before anything else
            special = np.flatnonzero((texts.data[:-1] == ord("<")) & (texts.data[1:] == ord("|")))
            whole = np.unique(np.searchsorted(texts.bounds, special, "right") - 1)
        else:
            whole = np.flatnonzero(np.diff(texts.bounds))
        low, starts, ends, kinds = spans(texts, whole)
        numbers = self.table.numbers(low, starts, ends, kinds)
        at, last = self.table.find(numbers), []
        missing = np.flatnonzero(at < 0)
        if len(missing):
            letters = LETTERS[low].tobytes().decode("utf-32-le")
            parts = [letters[i:j] for i, j in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            new = {p: i for p, i in zip(parts, missing.tolist(), strict=True) if p not in self.place}
            if new:
                last = self.learn(new, low, numbers, ends, kinds)
            at[missing] = [self.place[p] for p in parts]
        of_text = np.searchsorted(starts, texts.bounds[1:])  # parts up to the end of each text
        at = np.insert(at, of_text, 0)
        ids, begin = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.begin, np.int64)
        start, size = begin[at], begin[at + 1] - begin[at]
        to = np.cumsum(size)
        out = ids[np.arange(to[-1] if len(to) else 0) + np.repeat(start - to + size, size)]
        del ids, begin  # or the arrays could not grow
        self.forget(last)
        return out, np.concatenate(([0], to[of_text + np.arange(texts.n)]))

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all(Texts(0, np.frombuffer(text, np.uint8), np.array([0, len(text)])))[0]


_encoders: dict[tuple[str, int, int], Encoder] = {}


def encoder(vocabulary: str, end_id: int, remembered: int) -> Encoder:
    """The one of this Python worker; its words serve all its tasks."""
    key = (vocabulary, end_id, remembered)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


# ---------------------------------------------------------------- files


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(7)]


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class Writer:
    """One shard; add() takes keys in order."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{os.getpid()}-{os.urandom(4).hex()}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.zip = zstandard.ZstdCompressor(level=1)
        self.index: list[tuple[bytes, int, int, int]] = []
        self.block: list[bytes] = []
        self.keys: list[bytes] = []
        self.offset = self.in_block = self.n = self.tokens = 0
        self.first = self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first = self.last = key
            shared = 0
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        body = ids.astype("<u4").tobytes()
        narrow = not len(ids) or int(ids.max()) < 65536
        rest = key[shared:]
        self.block.append(struct.pack("<BBBII", shared, len(rest), 2 if narrow else 4, len(ids), zlib.crc32(body)) + rest + (ids.astype("<u2").tobytes() if narrow else body))
        self.last = key
        self.keys.append(key)
        self.n += 1
        self.in_block += len(ids)
        self.tokens += len(ids)
        if self.in_block >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.index.append((self.first, self.offset, len(data), len(self.block)))
            self.out.write(data)
            self.offset += len(data)
            self.block, self.in_block = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<BQQI", len(k), at, size, n) + k for k, at, size, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[bloom_places(k, bits)] = True
        packed = np.packbits(bloom).tobytes()
        small, large = (id_of(self.keys[0]), id_of(self.keys[-1])) if self.keys else (0, 0)
        null = bool(self.keys) and not self.keys[0]
        footer = FOOTER.pack(self.offset, len(index), self.offset + len(index), bits, self.n, self.tokens, null, small or 0, large or 0, MAGIC)
        self.out.write(index + packed + footer)
        self.out.close()
        self.fs.move(self.temporary, self.path)


class Reader:
    """One shard."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.file = self.fs.open_input_file(self.path)
        end = self.file.size()
        index_at, index_size, bloom_at, self.bits, self.n, self.tokens, _, _, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        self.bloom = np.frombuffer(self.file.read_at((self.bits + 7) // 8, bloom_at), np.uint8)
        raw, at, self.index = self.file.read_at(index_size, index_at), 0, []
        while at < len(raw):
            k, offset, size, n = struct.unpack_from("<BQQI", raw, at)
            at += 21
            self.index.append((raw[at : at + k], offset, size, n))
            at += k

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
        _, offset, size, _ = self.index[i]
        data, at, key = zstandard.ZstdDecompressor().decompressobj().decompress(self.file.read_at(size, offset)), 0, b""
        while at < len(data):
            shared, rest, width, n, crc = struct.unpack_from("<BBBII", data, at)
            at += 11
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{width}", n, at).astype("<u4"), crc
            at += n * width

    def entries(self) -> Iterator[tuple[bytes, np.ndarray, int]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier."""
        import bisect

        key = key_of(doc_id)
        if not self.n or not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(key, self.bits)):
            return []
        firsts = [x[0] for x in self.index]
        at, out = max(0, bisect.bisect_left(firsts, key) - 1), []
        while at < len(firsts) and firsts[at] <= key:
            out += [ids for k, ids, _ in self.block(at) if k == key]
            at += 1
        return out


# ---------------------------------------------------------------- tables


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Write the shards of docs below folder; (path, first_id, n, tokens) of each, in key order."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("h"))
    many = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(many, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, encode, writer = f"{folder}/part-{TaskContext.get().partitionId():06d}.sst", None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for texts in pieces(batch.column(1)):
                if writer is None:
                    encode, writer = encoder(vocabulary, end_id, remembered).encode_all, Writer(path)
                out, begin = encode(texts)
                for i in range(texts.n):
                    writer.add(key_of(ids[texts.first + i]), out[begin[i] : begin[i + 1]])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([int(path[-10:-4])], pa.int64()), "n": pa.array([writer.n], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    return dealt.mapInArrow(work, "path string, part long, n long, tokens long")


def manifest(spark: SparkSession, written: DataFrame) -> list[tuple[str, int]]:
    """Each shard's path and how many ids come before it; one small row for each shard."""
    before, out = 0, []
    for path, tokens in sorted((r["path"], r["tokens"]) for r in written.collect()):
        out.append((path, before))
        before += tokens
    return out


def entries(path: str, before: int) -> Iterator[pa.RecordBatch]:
    """A shard's digest, block by block.  All shards are written by now, so this worker's encoders go: other stages need the memory."""
    _encoders.clear()
    reader = Reader(path)
    for i in range(len(reader.index)):
        doc, start, n, crc = [], [], [], []
        for key, ids, stored in reader.block(i):
            if zlib.crc32(ids.tobytes()) != stored:
                raise ValueError(f"{path} is damaged")
            doc.append(id_of(key))
            start.append(before)
            n.append(len(ids))
            crc.append(stored)
            before += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, n, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, shards: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, a task for each shard."""
    table = spark.createDataFrame(shards or [], "path string, before long").repartition(max(1, len(shards)), "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from entries(path, before)

    return table.mapInArrow(work, ENTRY)


def export(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Write docs as shards, then the digest of what the files hold.

    The shards stay in folder, which must be new; without one they go when the driver ends.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    return read(spark, manifest(spark, write(docs, folder, vocabulary, end_id, remembered=remembered)))
