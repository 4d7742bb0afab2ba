"""Near-duplicate pairs by exact Jaccard similarity of word n-grams, with a prefix filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import let, terms
from lodestone.operators.search import small
from lodestone.operators.tables import stored


def shingles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, grams): the distinct word n-grams of each text, as sorted 64-bit hashes."""

    def grams(t):
        at = F.sequence(F.lit(1), F.greatest(F.size(t) - words + 1, F.lit(1)))
        return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(t, i, words), " ")))

    found = let(terms(F.col("text")), lambda t: F.when(F.size(t) >= words, grams(t)))
    return docs.select("doc_id", F.array_sort(F.array_distinct(found)).alias("grams")).filter(F.col("grams").isNotNull()).withColumn("n", F.size("grams"))


def members(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, head): each document with shingles and the smallest doc_id of its equal set, which stands for it in pairs."""
    own = stored(shingles(docs, words).select("doc_id", "n", F.xxhash64("grams").alias("h")), "near-sets")
    heads = own.groupBy("h", "n").agg(F.min("doc_id").alias("head"))
    return own.join(heads, ["h", "n"]).select("doc_id", "head")


def pairs(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_a, doc_b, jaccard) of different texts at or over the threshold.

    Equal sets are one class, stood for by its smallest doc_id (members() names it for each document), so large groups of copies never meet
    each other.  N-grams of one class only cannot make a pair and are left out; of the others a class
    brings its rarest ones, as many as any similar class must share one of, to the join.  Classes none of
    whose first n-grams stands among another's first ones are left out before anything is counted, and
    each n-gram is moved once to be counted.
    """
    own = stored(shingles(docs, words).withColumn("h", F.xxhash64("grams")), "near-sets")
    least = F.ceil(F.col("n") * percent / 100)
    # in the order of hashes, too, similar sets share one of their first n-grams: most sets end here
    first = own.select("h", F.explode(F.slice("grams", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("g"))
    by_gram = Window.partitionBy("g")
    live = first.select("h", F.min("h").over(by_gram).alias("low"), F.max("h").over(by_gram).alias("high")).filter("low <> high").select("h").distinct()
    heads = own.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id")).join(live, "h", "left_semi")
    sets = stored(own.join(small(stored(heads.select("doc_id"), "near-heads")), "doc_id", "left_semi").select("doc_id", "n", "grams"), "near-live")
    shared = sets.select("doc_id", "n", F.explode("grams").alias("g")).withColumn("df", F.count("*").over(by_gram)).filter("df > 1")
    by_doc = Window.partitionBy("doc_id")
    ranked = shared.withColumn("r", F.row_number().over(by_doc.orderBy("df", "g"))).withColumn("m", F.count("*").over(by_doc))
    front = stored(ranked.filter((F.col("m") >= least) & (F.col("r") <= F.col("m") - least + 1)).select("doc_id", "n", "g"), "near-front")
    other = front.select(F.col("doc_id").alias("doc_b"), F.col("n").alias("n_b"), "g")
    fit = (F.col("doc_id") < F.col("doc_b")) & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
    met = front.join(other, "g").filter(fit).select(F.col("doc_id").alias("doc_a"), "doc_b").distinct()
    left, right = (sets.select(F.col("doc_id").alias(f"doc_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    both = met.join(left, "doc_a").join(right, "doc_b").withColumn("o", F.size(F.array_intersect("grams_a", "grams_b")))
    union = F.size("grams_a") + F.size("grams_b") - F.col("o")
    return both.filter(100 * F.col("o") >= percent * union).select("doc_a", "doc_b", F.round(F.col("o") / union, 6).alias("jaccard"))
