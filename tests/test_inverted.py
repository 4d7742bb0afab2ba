"""The stored inverted index: exact results, blocks skipped, awkward rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import inverted, search


def rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def texts(spark):
    """Four languages of own words; a few rare words; texts that are null, empty or repeated."""
    word = F.concat(F.lit("w"), (F.col("id") % 4).cast("string"), F.lit("x"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 23), lambda k: F.concat(word, ((F.col("id") * 7 + k * k) % 31).cast("string"))), " ")
    text = F.when(F.col("id") % 97 == 5, F.lit(None)).when(F.col("id") % 97 == 6, F.lit(" .,")).when(F.col("id") % 50 == 0, F.concat(body, F.lit(" Zebra quagga"))).otherwise(body)
    return spark.range(1000).select("id", text.alias("text"), F.lit(1).alias("slab"), F.lit("x").alias("term"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "zebra QUAGGA w1x5"), (2, "w2x0 w2x1 w2x1 w3x2"), (3, "nothing like it"), (4, None), (5, "")], "query_id long, text string")


@pytest.mark.parametrize("slab, most, first", [(8, 10, 2), (64, 3, 1), (5000, 10, 4), (1, 2000, 1)])
def test_same_as_a_scan_of_all_postings(spark, tmp_path, texts, queries, slab, most, first):
    index = inverted.build(texts, str(tmp_path / "index"), slab)
    assert index.exists and not inverted.Index(spark, str(tmp_path / "none")).exists
    for weighed, scan in ((True, search.sparse), (False, search.bm25)):
        assert rows(inverted.top(index, queries, most, weighed, first)) == rows(scan(search.index(texts), queries, most))


def test_blocks_hold_all_postings_and_their_bounds(texts, tmp_path):
    index = inverted.build(texts, str(tmp_path / "index"), 16)
    kept = inverted.postings(index.blocks, "term").select("id", "term", "tf", "dl")
    all_of = search.postings(search.counted(texts)).select("id", "term", "tf", "dl")
    assert kept.exceptAll(all_of).count() == 0 and all_of.exceptAll(kept).count() == 0
    assert index.blocks.filter((F.size("ids") > 16) | (F.size("ids") != F.col("n")) | (F.array_max("tfs") != F.col("tf")) | (F.array_min("dls") != F.col("dl"))).count() == 0
    assert tuple(index.figures.first())[:2] == tuple(search.corpus_stats(search.counted(texts)).first())[:2]
    assert index.blocks.groupBy("term", "slab").count().filter("count > 1").count() == 0


def test_most_blocks_of_frequent_words_are_skipped(texts, queries, tmp_path):
    """The rare words of query 1 stand in one document in fifty; its frequent one is read only beside them."""
    index = inverted.build(texts, str(tmp_path / "index"), 4)
    read = {r["query_id"]: (r["read"], r["blocks"]) for r in inverted.searched(index, queries, 5)[1].collect()}
    assert read[1][0] * 3 < read[1][1]


def test_the_scan_is_pruned_by_terms(texts, queries, tmp_path):
    index = inverted.build(texts, str(tmp_path / "index"))
    mine = inverted.asked(index, queries)
    plan = index.blocks.select("term", "slab", "tf", "dl").filter(mine.at_scan)._jdf.queryExecution().executedPlan().toString()
    assert "Or(" in plan.split("PushedFilters")[1] and "ids" not in plan.split("ReadSchema")[1]


def test_an_index_is_kept_until_its_table_changes(spark, texts, tmp_path):
    path = str(tmp_path / "table")
    texts.limit(20).write.parquet(path)
    first = inverted.kept(spark, path, spark.read.parquet(path))
    assert inverted.kept(spark, path, spark.read.parquet(path)) is first
    texts.limit(5).write.mode("append").parquet(path)
    again = inverted.kept(spark, path, spark.read.parquet(path))
    assert again is not first and again.figures.first()["n_docs"] == 25


def test_no_documents(spark, queries, tmp_path):
    index = inverted.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "index"))
    assert inverted.top(index, queries, 3).collect() == []


def test_a_task_orders_no_more_than_a_segment(spark, texts, tmp_path, monkeypatch):
    """Memory of a task follows the segment, not its documents: batches are cut, and building sorts nothing else."""
    terms = pa.array([[{"term": f"t{k}", "tf": 1} for k in range(n)] for n in (3, 3, 3, 3, 3, 50, 3, 3, 0)])
    batch = pa.record_batch([pa.array(range(9)), pa.array([3] * 9), terms, pa.array(range(9))], names=["id", "dl", "terms", "alike"])
    monkeypatch.setattr(inverted, "SEGMENT", 13)
    assert [b.column(0).to_pylist() for b in inverted.segments(batch, 2)] == [[0, 1, 2, 3], [4], [5], [6, 7, 8]]
    counted = search.counted(texts).select("id", "dl", "terms", F.xxhash64("id").alias("alike"))
    blocks = inverted.in_blocks(counted, 16)
    assert "Sort" not in blocks._jdf.queryExecution().executedPlan().toString()
    blocks.filter("term IS NOT NULL").write.parquet(str(tmp_path / "b"))
    for path in (tmp_path / "b").glob("*.parquet"):
        own = [(r["term"], r["slab"]) for r in pq.read_table(path, columns=["term", "slab"]).to_pylist()]
        assert own == sorted(own)
