"""Benchmark decontamination (DataFrame functions only).

Benchmark items are cut into windows of ``width`` normalised words (a shorter item is one window).
Of each window the longest word is its anchor; neighbouring windows mostly share theirs.  The hash
set of anchors is small and bounded by the benchmark, so documents probe it word by word inside one
generated-code stage, without any shuffle of words.  Every hit is then verified: the words around it
are compared with the item's words around the anchor, and a matching run of at least ``width`` words
marks its words.  All windows that hold the anchor lie within ``width - 1`` words of it, so no
occurrence is missed.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z become a-z.

Defined cases: a null or wordless text has no words and is clean; null or wordless items have no
windows; a null item_id counts its windows' words but is no item in n_items or items_sha256; repeated
documents are judged one by one and alike; an empty benchmark leaves every document clean; an empty
documents table gives an empty result; other columns are ignored whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import shared_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what no word of any case holds
WIDTH = 13
MOST_ANCHORS = 500_000  # rows of one broadcast hash set; a larger benchmark is probed in blocks
MOST_BYTES = 128 << 20  # and bytes of its words


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def anchors(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(probe, item_id, at, need, left, right): one row per anchor place of an item.

    probe: the anchor lower-cased as documents are when they probe; left and right: the item's words
    up to width - 1 places before (nearest first) and after it; need: how long a run must be.
    """
    words = F.filter(F.split(ascii_lower(F.col("text")), BETWEEN), lambda w: w != "")
    items = benchmark.select("item_id", words.alias("words")).filter(F.size("words") > 0).distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    window = items.select("item_id", "words", F.explode(starts).alias("start"))
    window = window.withColumn("inside", F.slice("words", F.col("start") + 1, width))
    longest = F.array_max(F.transform("inside", lambda w, i: F.struct(F.length(w).alias("n"), w.alias("w"), i.alias("i"))))
    at = (F.col("start") + longest["i"]).alias("at")
    place = window.select("item_id", "words", longest["w"].alias("w"), at).distinct()
    before = F.greatest(F.col("at") - width + 1, F.lit(0))
    return place.select(
        F.lower("w").alias("probe"),
        "item_id",
        F.col("w").alias("anchor"),
        F.least(F.size("words"), F.lit(width)).alias("need"),
        F.reverse(F.slice("words", before + 1, F.col("at") - before)).alias("left"),
        F.slice("words", F.col("at") + 2, width - 1).alias("right"),
    )


def run_length(ours: Column, theirs: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, item_id, first, last): runs of words of documents that are in items.

    first and last are positions in ``split(text, BETWEEN)``.  The anchors are measured first: up to
    MOST_ANCHORS of MOST_BYTES together are broadcast as one hash set, more in blocks.
    """
    places = shared_table(anchors(benchmark, width), "anchors")
    held = F.length("anchor") + F.length(F.array_join("left", " ")) + F.length(F.array_join("right", " "))
    rows, size = places.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    blocks = max(1, -(-rows // MOST_ANCHORS), -(-size // MOST_BYTES))
    parts = [places.filter(F.pmod(F.xxhash64("anchor", "left", "right"), F.lit(blocks)) == k) if blocks > 1 else places for k in range(blocks)]
    found = [probed(docs, part, width) for part in parts]
    return reduce(DataFrame.unionByName, found).distinct()


def probed(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """The verified runs around one bounded set of anchors."""
    small = F.broadcast(places)
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", BETWEEN).alias("words"))
    # the outer form keeps the optimizer from evaluating the split once more to drop empty arrays
    word = words.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("at", "word"))
    # Of a window's other words, six or more stand on one side of the anchor, so on one side the two
    # nearest must agree; of a short item all words must.  Tested while probing, before a row is made.
    theirs = {1: F.get("right", F.lit(0)), 2: F.get("right", F.lit(1)), -1: F.get("left", F.lit(0)), -2: F.get("left", F.lit(1))}
    same = {k: F.lower(F.get("words", F.col("at") + k)) == F.lower(v) for k, v in theirs.items()}
    either = F.coalesce(same[1] & same[2], F.lit(False)) | F.coalesce(same[-1] & same[-2], F.lit(False))
    whole = F.lit(True)
    for k, v in theirs.items():
        whole = whole & (v.isNull() | F.coalesce(same[k], F.lit(False)))
    near = word.join(small, (F.lower("word") == F.col("probe")) & F.when(F.col("need") < width, whole).otherwise(either))
    from_ = F.greatest(F.col("at") - (width - 1), F.lit(0))
    # Only the words around are carried on, never the whole array.  The running number is there for the
    # filter below: no filter moves past such a column, and verifying inside the probe would break up
    # its generated code and copy the array for every word.
    around = near.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text_hash", "item_id", "anchor", "at", "need", "left", "right", (F.col("at") - from_).alias("before"), F.slice("words", from_ + 1, F.col("at") - from_ + width).alias("around"))
    low = around.withColumn("around", F.transform("around", ascii_lower))
    cut = low.select(
        ((F.col("n") >= 0) & (F.get("around", F.col("before")) == F.col("anchor"))).alias("same"),
        "doc_id",
        "text_hash",
        "item_id",
        "at",
        "need",
        "left",
        "right",
        F.reverse(F.slice("around", 1, F.col("before"))).alias("our_left"),
        F.slice("around", F.col("before") + 2, width - 1).alias("our_right"),
    )
    run = cut.select(
        "same",
        "doc_id",
        "text_hash",
        "item_id",
        "need",
        (F.col("at") - run_length(F.col("our_left"), F.col("left"))).alias("first"),
        (F.col("at") + run_length(F.col("our_right"), F.col("right"))).alias("last"),
    )
    return run.filter(F.col("same") & (F.col("last") - F.col("first") + 1 >= F.col("need"))).select("doc_id", "text_hash", "item_id", "first", "last")


def judged(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, width)
    # words covered by the union of runs: each run adds what lies beyond the furthest end so far, so a
    # run that another item has too adds nothing more
    order = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(reach, F.lit(-1))), F.lit(0))
    per_doc = found.withColumn("fresh", fresh).groupBy(F.col("doc_id").alias("hit_doc"), F.col("text_hash").alias("hit_hash"))
    per_doc = per_doc.agg(F.sum("fresh").cast("long").alias("n_hit"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    n_words = F.coalesce(F.size(F.filter(F.split("text", BETWEEN), lambda w: w != "")), F.lit(0)).cast("long")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words.alias("n_words"))
    out = base.join(per_doc, base["doc_id"].eqNullSafe(F.col("hit_doc")) & (base["text_hash"] == F.col("hit_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the contaminated ones; columns and rows otherwise as they were."""
    bad = judged(docs, benchmark, width).filter("contaminated").select(F.col("doc_id").alias("bad_doc"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with every hit word cut out of its text, and all else of the text kept."""
    found = hits(docs, benchmark, width)
    place = found.select("doc_id", "text_hash", F.explode(F.sequence("first", "last")).alias("at")).distinct()
    spots = place.groupBy(F.col("doc_id").alias("hit_doc"), F.col("text_hash").alias("hit_hash")).agg(F.collect_list("at").alias("spots"))
    both = docs.join(spots, docs["doc_id"].eqNullSafe(spots["hit_doc"]) & (F.xxhash64(docs["text"]) == spots["hit_hash"]), "left")
    words = F.split("text", BETWEEN)
    gaps = F.regexp_extract_all("text", F.lit(BETWEEN), F.lit(0))
    kept = F.transform(words, lambda w, i: F.when(F.array_contains("spots", i), F.lit("")).otherwise(w))
    cut = F.array_join(F.zip_with(kept, gaps, lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")
    return both.select(*[(F.when(F.col("spots").isNull(), docs["text"]).otherwise(cut).alias("text") if c == "text" else docs[c]) for c in docs.columns])
