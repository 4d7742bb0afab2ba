"""Plans and streaming."""

from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.plans import registry
from lodestone.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(spark):
    text = plan(registry.QUERIES["payload_filter_eq"](spark, SF))
    assert "EqualTo(lang,en)" in text and "text" not in text.split("ReadSchema")[1]


def test_topk_of_groups_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(registry.QUERIES["topk_per_group"](spark, SF))


def test_points_are_not_moved(spark):
    """Each task keeps its best; only those are dealt by query."""
    text = plan(registry.QUERIES["dense_topk"](spark, SF))
    assert text.count("Exchange") == 1 and "hashpartitioning(query_id" in text and text.index("Exchange") < text.index("MapInArrow")
    assert "Join" not in text


def test_prefetch_and_batches():
    assert [search.prefetch(n, 10, 500) for n in (100, 5000, 50000)] == [100, 100, 200]
    assert [search.batch_size(n) for n in (10, 500, 5000)] == [50, 100, 200]


def test_stream_upsert_keeps_the_last(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, at long").write.parquet(str(source))
    stream = spark.readStream.schema("k long, v string, at long").parquet(str(source))
    running = ingest.upserting(stream, str(tmp_path / "out"), "k", "at").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert {r["k"]: r["v"] for r in ingest.latest(spark, str(tmp_path / "out"), "k").collect()} == {1: "b", 2: "c"}


def test_stream_first_seen(spark, tmp_path):
    spark.createDataFrame([("x",), ("x",), ("y",)], "k string").write.parquet(str(tmp_path / "in"))
    stream = ingest.first_seen(spark.readStream.schema("k string").parquet(str(tmp_path / "in")), "k")
    assert ingest.run_once(stream, "append").agg(F.count("*")).collect()[0][0] == 2


def test_whole_tables_are_streamed(spark, tmp_path):
    """All files of a folder, of its partitions, and a single file with signs of a pattern in its name."""
    rows = spark.range(100).selectExpr("id", "CAST(id % 3 AS INT) AS part", "CAST(id % 7 AS STRING) AS text")
    for name, writer in (("flat", rows.repartition(5).write), ("parts.parquet", rows.write.partitionBy("part"))):
        writer.parquet(str(tmp_path / name))
        stream = ingest.stream_of(spark, str(tmp_path / name))
        assert ingest.run_once(stream.groupBy("part").count(), "complete").agg(F.sum("count")).first()[0] == 100
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("*.parquet")
    (tmp_path / "files").mkdir()
    file.rename(tmp_path / "files" / "a[1]{x}.parquet")
    rows.limit(3).toPandas().to_parquet(tmp_path / "files" / "a1x.parquet")
    path = str(tmp_path / "files" / "a[1]{x}.parquet")
    assert ingest.run_once(ingest.stream_of(spark, path, rows.schema).select("id"), "append").count() == 100


def test_stateful_keep_first(spark, tmp_path):
    for k, batch in enumerate(([("x", 2), ("x", 1), ("y", 5)], [("x", 0), ("z", 9), ("y", 1)])):
        spark.createDataFrame(batch, "k string, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.kept_first(spark.readStream.schema("k string, at long").parquet(str(tmp_path / "in")), "k", "at")
        seen = []
        running = stream.writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        running.awaitTermination()
        assert sorted(map(tuple, seen)) == [[("x", 1), ("y", 5)], [("z", 9)]][k]
