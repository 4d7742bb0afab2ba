"""Custom state over RocksDB: restarts, time to live, timers, hot keys."""

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import stateful

SF = "/root/testdata/sf0.001"
SCHEMA = "k string, n long, at timestamp"


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, "k string, n long, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, **how):
    """One start of the query on the folder's checkpoint; what it reports of all it was given until now."""
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    stateful.appended(stateful.first_of_key(stream, "k", "n", **how), f"{folder}/out", f"{folder}/state", once="live_ms" in how)
    return sorted((r["k"], r["place"]) for r in spark.read.parquet(f"{folder}/out").collect() if r["k"] is not None)


def test_state_is_found_again_after_a_restart(spark, tmp_path):
    day = "2024-01-01"
    deliver(spark, tmp_path, [("x", 5, day), ("x", 3, day), ("y", 9, day), (None, 4, day), ("z", None, day)])
    assert run(spark, tmp_path) == [("x", 3), ("y", 9)]
    deliver(spark, tmp_path, [("x", 4, day), ("x", 3, day), ("y", 2, day), ("z", 1, day)] + [("hot", 10 + k, day) for k in range(500)])
    assert run(spark, tmp_path) == [("hot", 10), ("x", 3), ("y", 2), ("y", 9), ("z", 1)]
    kept = {r["k"]: r["place"] for r in stateful.kept_state(spark, str(tmp_path / "state")).collect()}
    assert kept == {"x": 3, "y": 2, "z": 1, "hot": 10, None: 4}


def test_idle_keys_are_forgotten_by_a_timer(spark, tmp_path):
    """x is seen again within a day of its last row, then not for two days; y only once."""
    how = {"event_time": "at", "idle": "1 day", "delay": "1 minute"}
    deliver(spark, tmp_path, [("x", 5, "2024-01-01 00:00:00"), ("y", 7, "2024-01-01 01:00:00")])
    assert run(spark, tmp_path, **how) == [("x", 5), ("y", 7)]
    deliver(spark, tmp_path, [("x", 6, "2024-01-01 20:00:00"), ("w", 1, "2024-01-02 04:00:00")])
    assert run(spark, tmp_path, **how) == [("w", 1), ("x", 5), ("y", 7)]
    deliver(spark, tmp_path, [("x", 8, "2024-01-02 05:00:00"), ("y", 9, "2024-01-02 05:00:00")])
    assert run(spark, tmp_path, **how) == [("w", 1), ("x", 5), ("y", 7), ("y", 9)]
    deliver(spark, tmp_path, [("v", 2, "2024-01-05 00:00:00")])
    run(spark, tmp_path, **how)
    deliver(spark, tmp_path, [("x", 9, "2024-01-05 01:00:00")])
    assert run(spark, tmp_path, **how)[-4:] == [("x", 5), ("x", 9), ("y", 7), ("y", 9)]


def test_time_to_live(spark, tmp_path):
    deliver(spark, tmp_path, [("x", 1, "2024-01-01")])
    assert run(spark, tmp_path, live_ms=1) == [("x", 1)]
    deliver(spark, tmp_path, [("x", 2, "2024-01-01")])
    assert run(spark, tmp_path, live_ms=1) == [("x", 1), ("x", 2)]


@pytest.mark.parametrize("deliveries", [1, 3])
def test_first_documents(spark, deliveries):
    got = stateful.first_of_each_content(spark, f"{SF}/documents.parquet", deliveries)
    want = spark.read.parquet(f"{SF}/documents.parquet").groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state_follows_buckets_and_batches(spark, tmp_path):
    """Two batches of 5,000 keys that are never forgotten leave an entry for each bucket and batch, not one for each key."""
    for low in (10, 5):
        deliver(spark, tmp_path, [(f"k{k}", low + k % 3, "2024-01-01") for k in range(5000)])
        run(spark, tmp_path)
    folder = str(tmp_path / "state")
    rows = spark.read.format("statestore").option("stateVarName", "reported").load(folder).count()
    assert rows <= 2 * stateful.BUCKETS
    assert {r["place"] for r in stateful.kept_state(spark, folder).collect()} == {5, 6, 7} and stateful.kept_state(spark, folder).count() == 5000


@pytest.mark.parametrize("kind", ["bigint", "date", "binary"])
def test_keys_of_other_kinds(spark, tmp_path, kind):
    """Numbers that no double holds, nulls beside them, and a type that is tried one key at a time; over two starts."""
    k = F.nullif(F.col("id") % 3, F.lit(0))
    key = {"bigint": k + F.lit(2**60), "date": F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")), "binary": k.cast("string").cast("binary")}[kind]
    for n in (9, 8):
        table = spark.range(n).select(key.alias("k"), (n - F.col("id")).alias("n"))
        table.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
        stateful.appended(stateful.first_of_key(stream, "k", "n"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = spark.read.parquet(f"{tmp_path}/in").groupBy("k").agg(F.min("n").alias("place"))
    assert got.schema["k"].dataType.simpleString() == kind
    least = got.groupBy("k").agg(F.min("place").alias("place"))
    assert sorted(map(str, least.collect())) == sorted(map(str, want.collect())) and got.count() <= 6


def test_provider_is_put_back(spark):
    before = spark.conf.get(stateful.PROVIDER, None)
    with stateful.on_rocksdb(spark):
        assert spark.conf.get(stateful.PROVIDER) == stateful.ROCKSDB
    assert spark.conf.get(stateful.PROVIDER, None) == before
