"""Content deduplication, resumable anti-joins, update joins and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of each key that comes first by order.

    A minimum by the order column is summed up before the shuffle, so only one small row for each key
    and task moves, and a key with very many rows does no harm; a window would sort all of them.
    """
    names = df.columns
    least = df.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
    return df.withColumn("_key", key).join(least.withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & (F.col(order) == F.col("_first")), "left_semi").select(*names)


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that aren't done yet."""
    return df.join(done.select(key), key, "left_anti")


def merged(df: DataFrame, stored: DataFrame, key: str, column: str) -> DataFrame:
    """df with the stored value of a column where its own is null."""
    other = stored.select(F.col(key).alias("_k"), F.col(column).alias("_stored"))
    return df.join(other, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce(column, "_stored")).drop("_k", "_stored")


def carried(target: DataFrame, source: DataFrame, hash_column: str, value: str, order: str) -> DataFrame:
    """target with value taken over from the last source row of the same hash that has one."""
    last = source.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.col(hash_column).alias("_h")).agg(F.max_by(value, order).alias("_v"))
    return target.join(last, F.col(hash_column) == F.col("_h"), "left").withColumn(value, F.coalesce("_v", value)).drop("_h", "_v")


def upserted(table: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """table with the rows of news in place of its own of the same key."""
    return table.join(news.select(key), key, "left_anti").unionByName(news, allowMissingColumns=True)


def synced(table: DataFrame, news: DataFrame, file: str) -> DataFrame:
    """table with all rows of the files in news replaced by those of news."""
    return table.join(news.select(file).distinct(), file, "left_anti").unionByName(news)


def inserted(table: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """table and the rows of news with new keys; rows with known keys are ignored."""
    return table.unionByName(news.join(table.select(key), key, "left_anti").dropDuplicates([key]))
