"""One document of each component stays, also where ids are null or stand for several texts."""

from lodestone.llm import ngram_join


def words(name):
    return " ".join(f"{name}{i}" for i in range(30))


def test_null_and_repeated_ids(spark):
    texts = [(None, words(x)) for x in "abc"] + [(None, words("a").upper()), (None, ""), (None, "")]
    texts += [(5, words("d")), (5, words("e")), (5, words("d")), (5, " "), (3, words("f")), (6, words("f") + " end"), (6, words("g")), (None, words("g")), (7, words("h"))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, cls int").repartition(3)
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), r["text"].lower()) for r in out.collect())
    want = [(0, ""), *((0, words(x)) for x in "abc"), (3, words("f")), (5, " "), (5, words("d")), (5, words("e")), (6, words("g")), (7, words("h"))]
    assert got == sorted(want)
