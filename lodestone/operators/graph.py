"""Property graphs as edge tables: building, neighbours by depth, paths, expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.search import small
from lodestone.operators.tables import stored


def edges(*kinds: tuple[DataFrame, str, str, str]) -> DataFrame:
    """(src, dst, type): one edge for each pair of keys in each (table, src, dst, type)."""
    parts = [df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(kind).alias("type")).filter("src IS NOT NULL AND dst IS NOT NULL") for df, src, dst, kind in kinds]
    return reduce(DataFrame.unionByName, parts).distinct()


def reversed_edges(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").unionByName(reversed_edges(e))


def reach(e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): nodes within so many hops of starts (start), at their least depth.

    Breadth first, a join for each hop; what was reached before is left out of the next hop, so paths
    never multiply.  Each frontier is written, so a hop's plan holds that hop only; the walk ends early
    where a frontier is empty.  The result has a row for each start and node: give the starts that are
    asked for.
    """
    step = stored(e.select("src", "dst").distinct(), "edges")
    seen = front = stored(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "front-0")
    for hop in range(1, depth + 1):
        found = front.join(met(step, front), "node").select("start", F.col("dst").alias("node")).distinct()
        front = stored(found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(hop)), f"front-{hop}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def met(step: DataFrame, front: DataFrame) -> DataFrame:
    """(node, dst): the edges that leave a frontier, sent to it while they are few, so many walks that meet in one node aren't one task's."""
    nodes = front.select(F.col("node").alias("src")).distinct()
    return small(stored(step.join(nodes, "src", "left_semi").select(F.col("src").alias("node"), "dst"), "met"))


def paths(e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance, path): a shortest way from each start (start) to all nodes within so many hops.

    Of several, each node is reached from the least node one hop nearer.
    """
    step = stored(e.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    seen = front = stored(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"), F.array("start").alias("path")).dropDuplicates(["start"]), "paths-0")
    for hop in range(1, depth + 1):
        found = front.join(met(step, front), "node").groupBy("start", "dst").agg(F.min_by("path", "node").alias("path"))
        found = found.select("start", F.col("dst").alias("node"), F.lit(hop).alias("distance"), F.concat("path", F.array("dst")).alias("path"))
        front = stored(found.join(seen.select("start", "node"), ["start", "node"], "left_anti"), f"paths-{hop}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def direct(e: DataFrame) -> DataFrame:
    """(node, dependencies, dependents): how many edges go out of and come into each node."""
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("dependencies"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependents"))
    both = out.join(into, "node", "full")
    return both.select("node", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


def spread(value: DataFrame, step: DataFrame, better) -> DataFrame:
    """(node, v): each node's best value among its own and those of all nodes that lead to it.

    Only nodes whose value changed hand it on.
    """
    front = value
    while True:
        given = step.join(front, step["src"] == front["node"]).select(F.col("dst").alias("node"), "v", F.lit(None).alias("old"))
        both = value.select("node", "v", F.col("v").alias("old")).unionByName(given).groupBy("node")
        new = stored(both.agg(better("v").alias("v"), better("old").alias("old")), "spread")
        value, front = new.select("node", "v"), new.filter(~F.col("v").eqNullSafe(F.col("old"))).select("node", "v")
        if front.isEmpty():
            return value


def cycles(e: DataFrame) -> DataFrame:
    """(node): nodes on a cycle of any length; see contract.py."""
    from lodestone.operators import contract  # which builds on this module

    return contract.strong(e).select("node")


def proximity(depth):
    return F.lit(1.0) / (depth + F.lit(1))


def within_budget(rows: DataFrame, size: str, budget: int, score: str, key: str, *by: str) -> DataFrame:
    """rows with total, by score until the first that would exceed the budget of their group; key is unique.

    Sizes are summed by group and score first, so only rows down to the score at which the budget ends
    are sorted; and of those with a size, as each has one at least, no more than the budget.  Rows of
    size 0 take part as they are.
    """
    rows = rows.filter(F.col(size).isNotNull())
    bars = rows.groupBy(*by, score).agg(F.sum(size).alias("bar"))
    upto = F.sum("bar").over(Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the best score at which the budget is exceeded; a group that never exceeds it has none
    ends = bars.withColumn("upto", upto).filter(F.col("upto") > budget).groupBy(*by).agg(F.max(score).alias("least"))
    ends = small(stored(ends.select(*[F.col(c).alias(f"{c}_end") for c in by], "least"), "budget-ends"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_end"))
    near = rows.join(ends, same, "left").filter(F.col("least").isNull() | (F.col(score) >= F.col("least"))).select(*rows.columns)
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    some = near.filter(F.col(size) > 0).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= budget + 1).drop("nth")
    both = some.unionByName(near.filter(F.col(size) <= 0))
    total = both.withColumn("total", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return total.filter(F.col("total") <= budget)
