"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document gets a 36-bit hash.  Whole copies follow from target / source size; the rest of a
source's budget goes to the documents whose hash lies below the source's threshold.  The threshold
comes from nested histograms: tokens are summed by source and 12-bit hash bucket, the bucket in
which the budget ends is refined by the next 12 bits, and so on.  No step sorts documents.

Sources themselves are few: one row for each is sorted in one task to share out the targets.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a null
doc_id hashes like an empty string; rows with the same doc_id hash alike, so they are taken or left
together; a source of size 0 has target 0; an empty table gives an empty result; columns other than
the named ones are ignored whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import shared_table

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_DIGITS = 3  # hex digits of the hash that one histogram level adds: 4096 buckets
LEVELS = 3
SENT = 1_000_000  # sources whose plan is broadcast


def few(by_source: DataFrame) -> DataFrame:
    """A written table with a row for each source, broadcast while counted few, so no source's rows are dealt to one task."""
    return F.broadcast(by_source) if by_source.count() <= SENT else by_source


def hashed(doc_id: Column) -> Column:
    """9 hex digits of an md5."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, LEVEL_DIGITS * LEVELS)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): one slim row per document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return docs.select("doc_id", "source", size, hashed(F.col("doc_id")).alias("h"))


def targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, target): weighted shares of all words; no target is above cap * size.

    Sources that reach the cap stop there and the excess goes to the others by weight.  With sources
    in the order in which they reach it (cap * size / weight), the level that the rest share follows
    from running sums.  Only one row per source is sorted.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    ranked = ranked.withColumn("reach", F.col("most") / F.col("weight"))
    every = Window.partitionBy()
    order = Window.orderBy("reach", F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    # the first source below its cap fixes the level for itself and for all after it
    ranked = ranked.withColumn("level", F.when(level < F.col("reach"), level))
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most"))).alias("target"),
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, cut, keep_cut): hashes below cut are taken once more; those equal to it if keep_cut.

    Each level sums sizes by the next digits of the hash, only within the bucket in which the budget
    of the source ends.  Of the last bucket, which the hash cannot split, the nearer sum wins.
    """
    cut = few(goals).select("source", F.lit("").alias("cut"), (F.col("target") - F.floor(F.col("target") / F.greatest("source_size", F.lit(1))) * F.col("source_size")).alias("rest"))
    for level in range(1, LEVELS + 1):
        inside = sized.filter(F.col("size") > 0).join(
            cut.select(F.col("source").alias("s"), "cut", "rest"),
            F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, LEVEL_DIGITS * (level - 1)) == F.col("cut")),
        )
        bars = inside.groupBy("s", "rest", F.substring("h", 1, LEVEL_DIGITS * level).alias("cut")).agg(F.sum("size").alias("bar"))
        upto = Window.partitionBy("s").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bars = bars.withColumn("upto", F.sum("bar").over(upto))
        edge = bars.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("bar") <= F.col("rest")))
        edge = edge.select(F.col("s").alias("source"), "cut", (F.col("rest") - F.col("upto") + F.col("bar")).alias("rest"), "bar")
        cut = few(shared_table(edge, "mix-cuts"))
    return cut.select("source", "cut", (F.col("bar") - F.col("rest") <= F.col("rest")).alias("keep_cut"))


def plan(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(s, source_size, target, cut, keep_cut): one row for each source s, all that a copy count needs."""
    goals = shared_table(targets(sized, weights, cap), "mix-targets")
    cuts = thresholds(sized, goals)
    both = goals.join(cuts, goals["source"].eqNullSafe(cuts["source"]), "left")
    return shared_table(both.select(goals["source"].alias("s"), "source_size", "target", "cut", "keep_cut"), "mix-plan")


def copies(h: Column) -> Column:
    """How often the mix takes a document with hash h, beside the plan's row of its source."""
    more = F.coalesce((h < F.col("cut")) | ((h == F.col("cut")) & F.col("keep_cut")), F.lit(False))
    return F.floor(F.col("target") / F.greatest("source_size", F.lit(1))) + more.cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of docs."""
    sized = shared_table(sizes(docs), "mix-sizes")
    out = sized.join(few(plan(sized, weights, cap)), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies(F.col("h")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, once or more); columns as they were.

    The plan has one row for each source and is joined by source, so texts are not dealt out anew.
    """
    own = plan(shared_table(sizes(docs), "mix-sizes"), weights, cap)
    own = few(own).select(F.col("s").alias("mix_s"), F.struct("source_size", "target", "cut", "keep_cut").alias("mix_plan"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = rows.join(own, F.col("row.source").eqNullSafe(F.col("mix_s"))).select("row", "mix_plan.*").withColumn("times", copies(hashed(F.col("row.doc_id"))))
    return taken.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
