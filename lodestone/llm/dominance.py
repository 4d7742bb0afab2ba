"""Dominance counting: for each sale, how many others come no later and have a strictly higher level.

Weighted inversion counting by an external multiway merge sort.  Sales of equal slot and level are one
weighted entry, summed up before anything is dealt out.

1. Runs.  Entries are dealt in slot order into runs of about RUN, each one task.  A slot group stands
   with its higher levels first, so that group mates with a higher level count as earlier, and equal
   levels never do, wherever a group is cut.  A run is merge-sorted by level in memory: when the merge
   takes an entry, it is credited with what is left in the earlier parts, all of higher level.
2. Merge.  All runs are merged by level.  The merge is cut into bands of about RUN entries, each one
   task; entries of one level stand in slot order, so those behind an entry in the merge and in an
   earlier run have a higher level.  An entry is credited with what its band still holds of earlier runs.
3. What earlier runs hold in all higher bands comes from sums for each run and band: two running sums
   over a grid of runs x bands (no more cells than entries while there are fewer than RUN * RUN of those).

Nothing that grows with the input goes to the driver or into a broadcast; entries that stand for more
than a HEAVY-th of all sales, fewer than HEAVY therefore, are joined back by broadcast, so that a hot slot
and level isn't dealt to one task.

Defined cases: a sale whose slot or level is null (or whose total is not finite) is above none and has
null counts; a null sale_id is an empty text to crc32; repeated rows count each; sold_at before 1970 has
a negative slot; a timestamp with a zone is taken as its instant; an empty table gives an empty result;
columns other than sale_id, sold_at and total are ignored whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from lodestone.llm.shared import shared_table, temporary

RUN = 200_000  # entries of a run, and of a band of the merge
FAN = 8  # parts that an in-memory merge takes at once
HEAVY = 10_000

ENTRY = "slot long, level long, n long, w long"
CREDITED = f"{ENTRY}, n_above long, w_above long, run int"


def slot_of(sales: DataFrame) -> Column:
    """Whole hours since 1970 of sold_at, which names no zone and is taken as UTC."""
    at = F.col("sold_at")
    if isinstance(sales.schema["sold_at"].dataType, TimestampType):
        return F.floor(F.unix_seconds(at) / 3600)
    return F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(at)


def level_of(total: Column) -> Column:
    """floor(floor(100 * total + 0.5) / 100) in doubles; from 2 ** 53 on every double is whole."""
    cents = total.cast("double") * 100 + 0.5
    whole = F.when(F.abs(cents) < float(1 << 53), F.floor(cents).cast("double")).otherwise(cents)
    return F.when(F.abs(cents) < float("inf"), F.floor(whole / 100))


def keyed(sales: DataFrame) -> DataFrame:
    """(sale_id, slot, level, w): what counting needs of each sale; w is the number of rows that it stands for."""
    weight = 1 + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % 2
    return sales.select("sale_id", slot_of(sales).alias("slot"), level_of(F.col("total")).alias("level"), weight.alias("w"))


def credits(rank: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each entry the weights of those before it whose rank is higher; ranks are 0 to n - 1, each once.

    A bottom-up merge sort by rank, FAN runs at a time, all groups of runs at once: behind an entry's
    place in the merged order stands what is left of each run, and that of earlier runs is credited.
    """
    n, width = len(rank), 1
    out = [np.zeros(n, np.int64) for _ in weights]
    place = np.arange(n)
    while width < n:
        wide = width * FAN
        order = np.argsort(place // wide * n + rank, kind="stable")
        part = order // width % FAN
        end = np.minimum((place // wide + 1) * wide, n)
        moved = [w[order] for w in weights]
        gained = [np.zeros(n, np.int64) for _ in weights]
        for k in range(FAN - 1):
            own, later = part == k, part > k
            for w, gain in zip(moved, gained, strict=True):
                upto = np.concatenate(([0], np.cumsum(np.where(own, w, 0))))
                gain += np.where(later, upto[end] - upto[1:], 0)
        for gain, total in zip(gained, out, strict=True):
            total[order] += gain
        width = wide
    return out


def whole(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """All rows of a partition, by column."""
    got = list(batches)
    return {name: np.concatenate([np.zeros(0, kind), *(b.column(name).to_numpy(zero_copy_only=False) for b in got)]).astype(kind) for name, kind in kinds.items()}


def in_runs(entries: DataFrame, parts: int) -> DataFrame:
    """Entries in slot order, cut into runs, with what is above them in their own run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = whole(batches, {c: np.int64 for c in ("slot", "level", "n", "w")})
        rank = np.empty(len(x["slot"]), np.int64)
        rank[np.lexsort((x["slot"], x["level"]))] = np.arange(len(rank))
        n_above, w_above = credits(rank, [x["n"], x["w"]])
        run = np.full(len(rank), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_pydict(x | {"n_above": n_above, "w_above": w_above, "run": run})

    order = [F.col("slot"), F.col("level").desc()]
    return entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(work, CREDITED)


def merged(runs: DataFrame, parts: int) -> DataFrame:
    """Entries in the order of levels, cut into bands, credited with what their band holds of earlier runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = whole(batches, {c: np.int64 for c in ("slot", "level", "n", "w", "n_above", "w_above")} | {"run": np.int32})
        by_run = np.argsort(x["run"], kind="stable")
        n_above, w_above = credits(by_run, [x["n"][by_run], x["w"][by_run]])
        x["n_above"][by_run] += n_above
        x["w_above"][by_run] += w_above
        yield pa.RecordBatch.from_pydict(x | {"band": np.full(len(by_run), TaskContext.get().partitionId(), np.int32)})

    order = [F.col("level"), F.col("slot")]
    return runs.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(work, f"{CREDITED}, band int")


def beyond(bands: DataFrame, parts: int) -> DataFrame:
    """(run, band, n_beyond, w_beyond): what earlier runs hold in higher bands."""
    sums = bands.groupBy("run", "band").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    cells = bands.sparkSession.range(parts * parts).select((F.col("id") / parts).cast("int").alias("run"), (F.col("id") % parts).cast("int").alias("band"))
    grid = cells.join(sums, ["run", "band"], "left")
    higher = Window.partitionBy("run").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("band").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    up = grid.select("run", "band", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(c) for c in ("n", "w")])
    return up.select("run", "band", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_beyond") for c in ("n", "w")])


def counted(entries: DataFrame, run: int = RUN) -> DataFrame:
    """(slot, level, n, n_sales, n_rows) of entries (slot, level, n, w) that differ in slot or level."""
    parts = max(1, math.ceil(entries.count() / run))
    if parts == 1:
        one = in_runs(entries, 1)
        return one.select("slot", "level", "n", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))
    runs = shared_table(in_runs(entries, parts), "dominance-runs")
    bands = shared_table(merged(runs, parts), "dominance-bands")
    most = bands.agg(F.greatest(F.max("run"), F.max("band"))).first()[0] + 1
    rest = beyond(bands, max(parts, most))
    return bands.join(rest, ["run", "band"]).select(
        "slot", "level", "n", (F.col("n_above") + F.col("n_beyond")).alias("n_sales"), (F.col("w_above") + F.col("w_beyond")).alias("n_rows")
    )


def dominated(sales: DataFrame, run: int = RUN) -> DataFrame:
    """(sale_id, slot, level, n_sales, n_rows) for every row of sales."""
    rows, spark = keyed(sales), sales.sparkSession
    known = F.col("slot").isNotNull() & F.col("level").isNotNull()
    with temporary(spark):
        entries = rows.filter(known).groupBy("slot", "level").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
        entries = shared_table(entries, "dominance-entries")
        counts = shared_table(counted(entries, run), "dominance-counts", outer=1)
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > total
    frequent = counts.filter(heavy).select(F.col("slot").alias("s"), F.col("level").alias("l"), "n_sales", "n_rows")
    met = rows.join(F.broadcast(frequent), (F.col("slot") == F.col("s")) & (F.col("level") == F.col("l")), "left")
    done = met.filter(F.col("s").isNotNull() | ~known).select("sale_id", "slot", "level", "n_sales", "n_rows")
    few = met.filter(F.col("s").isNull() & known).select("sale_id", "slot", "level")
    return done.unionByName(few.join(counts.filter(~heavy).drop("n"), ["slot", "level"]).select("sale_id", "slot", "level", "n_sales", "n_rows"))
