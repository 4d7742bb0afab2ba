"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import shared_table, temporary


SENT = 1_000_000  # rows of two numbers that are broadcast


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Each round ties every neighbour of a node, and the node, to the smallest of them, which halves
    distances, until each node has one edge, to the root.  Minima are summed up before the shuffle, and
    only nodes that aren't their own minimum are joined (broadcast while counted few): the star of a
    root stays as it is and isn't dealt out by its root.
    """
    spark = edges.sparkSession
    with temporary(spark):
        stars = shared_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        while True:
            both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
            least = shared_table(least.filter("m < node"), f"{name}-least")
            own = F.broadcast(least) if least.count() <= SENT else least
            tied = both.join(own, F.col("a") == F.col("node"), "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))
            stars = shared_table(tied.filter("a > b").unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), name)
            # done when no node has two smaller neighbours and no smaller neighbour has one of its own
            upper = stars.groupBy("a").agg(F.count("*").alias("n"))
            lower = stars.select("b").distinct()
            if not upper.filter("n > 1").limit(1).count() and not lower.join(upper, F.col("b") == F.col("a"), "left_semi").limit(1).count():
                out = stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(lower.select(F.col("b").alias("node"), F.col("b").alias("root")))
                return shared_table(out, f"{name}-roots", outer=1)
