"""Structured Streaming forms of incremental work: dedup, windows, upserts, custom state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.text import content_hash
from lodestone.operators.tables import new_folder


def stream_of(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All files of the Parquet table at path, a folder (with its partitions) or one file, as a stream."""
    schema = schema or spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", re.sub(r"([*?\[\]{}\\])", r"\\\1", name)).parquet(folder)
    return reader.parquet(path)


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there run through the stream, and its result as a table on disk."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, "stream")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/table")

    running = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/table")


def counted_by_hash(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, n) of the texts of a table, kept up to date as files arrive."""
    stream = stream_of(spark, path).select(content_hash(F.col("text")).alias("content_hash"))
    return run_once(stream.groupBy("content_hash").agg(F.count("*").alias("n")), "complete")


def first_seen(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key; with an event time, state is kept for delay only."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def different(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash): each content of a table once, as files arrive."""
    return run_once(first_seen(stream_of(spark, path).select(content_hash(F.col("text")).alias("content_hash")), "content_hash"), "append")


def windowed(spark: SparkSession, path: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(hour, event_type, n, total) in event-time windows; complete mode, so open windows show too."""
    stream = stream_of(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    out = stream.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return run_once(out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total")), "complete")


def upserting(stream: DataFrame, path: str, key: str, order: str):
    """A running query that keeps at path a table of versions; the last row of a key counts.

    Each batch writes the last row of each of its keys under its batch number, so a batch that runs
    again replaces its own rows only.  latest() reads the table's current state.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        last.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The current state of an upserted table."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("row")).select("row.*").drop("batch")


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """(key, n) after each batch, with state kept by Python code."""

    def work(value: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        state.update((n,))
        yield pd.DataFrame({key: [value[0]], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(work, f"{key} string, n long", "n long", "update", "NoTimeout")


def kept_first(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first, by order within a batch, with state kept by Python code.

    Later batches never bring a row of a key that was seen.  The state is one flag for each key.
    """
    rest = [f for f in stream.schema.fields if f.name != key]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    kind = stream.schema[key].dataType.simpleString()

    def work(value: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first = None
        for part in parts:
            own = part.sort_values(order, kind="stable").head(1)
            first = own if first is None or own[order].iloc[0] < first[order].iloc[0] else first
        if not state.exists and first is not None:
            state.update((True,))
            yield first[[key, *(f.name for f in rest)]]

    return stream.groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, {fields}", "seen boolean", "append", "NoTimeout")
