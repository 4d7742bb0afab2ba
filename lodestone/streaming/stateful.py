"""State kept by custom processors over the RocksDB state store: the first row of each key.

Before rows are dealt by key each batch of them is reduced to its first row of each key, so a hot key
sends one row for each batch and not all of them.  A row is reported when it comes before all that were
seen of its key, so whatever the order in which files arrive, the first of the rows reported is the first of all.

Keys that are never forgotten are dealt into BUCKETS by a hash, and a bucket is tried at once: its state is a
list with one entry for each batch, which holds the rows that were reported then.  So what is asked of the
state store follows buckets and batches, not keys.  Keys that are forgotten, or whose type has no exact
text, are tried one at a time.

Keys are forgotten either by time to live (so long after their state was last written, by the clock)
or by a timer (so long after the last row of the key, by event time), or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions.text import content_hash
from lodestone.operators.tables import new_folder, stored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 1024  # of keys; a checkpoint is bound to their number
NAMED = ("string", "bigint", "int", "smallint", "tinyint", "boolean", "date")  # types of keys that are told by their text
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Reports (key, place) when place is below all seen of the key."""

    def __init__(self, key: str, live_ms: int | None = None, idle_ms: int | None = None):
        self.key, self.live_ms, self.idle_ms = key, live_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.least = handle.getValueState("least", "place long", self.live_ms)
        if self.idle_ms is not None:
            self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place, seen = None, None
        for part in rows:
            low = int(part["place"].min())
            place = low if place is None else min(place, low)
            if self.idle_ms is not None:
                at = int(part["at"].max().timestamp() * 1000)
                seen = at if seen is None else max(seen, at)
        if seen is not None:
            self.wait(seen + self.idle_ms)
        if not self.least.exists() or place < self.least.get()[0]:
            self.least.update((place,))
            yield pd.DataFrame({self.key: [key[0]], "place": [place]})

    def wait(self, until: int) -> None:
        """Move the key's timer, never back."""
        if self.ends.exists():
            before = self.ends.get()[0]
            if before >= until:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(until)
        self.ends.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.least.clear()
        self.ends.clear()
        return iter(())

    def close(self) -> None:
        pass


class FirstOfKeys(StatefulProcessor):
    """Reports (key, place) of a bucket's keys, which are texts, where place is below all seen of the key."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reported = handle.getListState("reported", "keys array<string>, places array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict = {}
        for part in rows:
            for k, place in zip(part[self.key].tolist(), part["place"].tolist()):
                if k not in new or place < new[k]:
                    new[k] = place
        for keys, places in self.reported.get():
            for k, place in zip(keys, places):
                if k in new and new[k] >= place:
                    del new[k]
        if new:
            keys, places = list(new), list(new.values())
            self.reported.appendValue((keys, places))
            yield pd.DataFrame({self.key: pd.Series(keys, dtype=object), "place": places})

    def close(self) -> None:
        pass


def reduced(stream: DataFrame, key: str, with_time: bool) -> DataFrame:
    """The first row of each key in each batch of rows of a task; at is the latest time of the key there."""
    fields = [key, "place", *(["at"] if with_time else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [("place", "min"), *([("at", "max")] if with_time else [])]
            least = pa.Table.from_batches([batch]).group_by(key).aggregate(sums)
            yield from least.rename_columns([c.removesuffix("_min").removesuffix("_max") if c != key else c for c in least.column_names]).select(fields).to_batches()

    rows = stream.select(*fields)
    return rows.mapInArrow(work, rows.schema)


def first_of_key(stream: DataFrame, key: str, place: str, live_ms: int | None = None, event_time: str | None = None, idle: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """(key, place) of rows that come before all seen of their key; rows with a null place are left out.

    With an event time, a key is forgotten when the watermark is idle past its last row.
    """
    rows = stream.filter(F.col(place).isNotNull()).withColumn("place", F.col(place).cast("long"))
    kind = stream.schema[key].dataType.simpleString()
    idle_ms = None
    if event_time is not None:
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
        # mapInArrow drops the mark of the event time, so it is set behind it
        rows = reduced(rows.withColumn("at", F.col(event_time).cast("timestamp")), key, True).withWatermark("at", delay)
    else:
        rows = reduced(rows, key, False)
        if live_ms is None and kind in NAMED:
            named = rows.select(F.col(key).cast("string").alias(key), "place", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"))
            found = named.groupBy("bucket").transformWithStateInPandas(FirstOfKeys(key), f"`{key}` string, place long", "Update", "None")
            return found.select(F.col(key).cast(kind).alias(key), "place")
    mode = "EventTime" if event_time else "ProcessingTime" if live_ms else "None"
    return rows.groupBy(key).transformWithStateInPandas(FirstOfKey(key, live_ms, idle_ms), f"`{key}` {kind}, place long", "Update", mode)


@contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as custom processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def appended(out: DataFrame, path: str, state: str, once: bool = False) -> None:
    """All that is there now run through a query with its state at a path, from where a run before left off.

    A batch that runs again replaces its own rows.  once: in one batch; a query whose keys have a time to
    live needs it, as batches without rows would go on for ever to let keys expire.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with on_rocksdb(out.sparkSession):
        writer = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", state)
        running = (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start()
    running.awaitTermination()


def first_of_each_content(spark: SparkSession, path: str, deliveries: int = 2, files: int = 3) -> DataFrame:
    """(content_hash, doc_id): the first document of each content, of a table delivered in parts.

    The files of each delivery are batches of their own; the query is started anew for each delivery
    and goes on from its state.
    """
    folder = new_folder(spark, "deliveries")
    docs = stored(spark.read.parquet(path).select("doc_id", content_hash(F.col("text")).alias("content_hash")), "hashes")
    schema = docs.schema
    for k in range(deliveries):
        own = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(deliveries)) == k)
        own.repartition(files).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        appended(first_of_key(stream, "content_hash", "doc_id"), f"{folder}/table", f"{folder}/state")
    reported = spark.read.schema("content_hash string, place long").parquet(f"{folder}/table")
    return reported.groupBy("content_hash").agg(F.min("place").alias("doc_id"))


def kept_state(spark: SparkSession, state: str) -> DataFrame:
    """(k, place): what a query of first_of_key that deals keys into buckets remembers now, by the state reader; k is the key's text."""
    rows = spark.read.format("statestore").option("stateVarName", "reported").load(state)
    seen = rows.select(F.explode(F.arrays_zip("list_element.keys", "list_element.places")).alias("seen")).select(F.col("seen.keys").alias("k"), F.col("seen.places").alias("place"))
    return seen.groupBy("k").agg(F.min("place").alias("place"))
