"""Near duplicates: copies are traced to the document that stands for them."""

from lodestone.operators import near


def test_copies_are_members(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text.upper().replace(" ", ", ")), (2, text), (7, text + " end"), (8, text + " END."), (9, "too few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["head"]) for r in near.members(docs).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert [(r["doc_a"], r["doc_b"]) for r in near.pairs(docs).collect()] == [(1, 7)]


def test_only_sets_that_may_be_similar_are_counted(spark, monkeypatch):
    """Same pairs as all against all; sets that share no n-gram among their first ones are not moved."""
    words = [[f"t{d}w{i}" for i in range(12 + d)] for d in range(30)]
    words += [[*words[4], "more"], [*words[9][:-1], "other"], words[4][:6] + [f"z{i}" for i in range(30)], words[20] * 2, words[7]]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(words)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    every = {(a, b) for b in range(len(sets)) for a in range(b) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    moved, stored = {}, near.stored

    def counted(df, name):
        out = stored(df, name)
        moved[name] = out.count()
        return out

    monkeypatch.setattr(near, "stored", counted)
    assert {(r["doc_a"], r["doc_b"]) for r in near.pairs(docs).collect()} == every and len(every) >= 2
    assert moved["near-sets"] == 35 and moved["near-live"] <= 8
