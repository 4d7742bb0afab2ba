"""Perplexity: no n-gram is left out of a model, and copies don't sway it."""

import random

import numpy as np
import pyarrow as pa

from lodestone.llm import perplexity
from lodestone.llm.batches import pieces

STEMS = ["river", "stone", "house", "under", "the", "old", "wind", "road", "song", "night"]


def prose(rng, n=150):
    return " ".join(rng.choice(STEMS) + rng.choice(["", "s", "ed", str(rng.randrange(99))]) for _ in range(n))


def test_models_are_of_all_ngrams(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "MOST", 200, raising=False)
    rng = random.Random(7)
    rows = [(i, prose(rng), lang) for i in range(30) for lang in ("en", None)] + [(99, "a", "one")]
    got = perplexity.models(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"en", None, "one"}
    for lang in got:
        (t,) = pieces(pa.array([text for _, text, own in rows if own == lang]))
        key, _ = perplexity.hashed(t)
        want = perplexity.Model(*np.unique(key, return_counts=True))
        probe = np.concatenate((key, key ^ np.uint64(3), key & np.uint64(0xFFF)))
        np.testing.assert_allclose(got[lang].log_p(probe), want.log_p(probe), rtol=1e-5, atol=1e-5)
        assert len(got[lang].levels[-1][0]) == len(want.levels[-1][0])


def test_copies_do_not_move_the_band(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng), "en") for i in range(100)]
    copy = " ".join(f"{a}{b}" for a in "abcdefgh" for b in STEMS)
    rows += [(1000 + i, copy, "en") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in perplexity.judged(frame).collect()}
    clean = [got[i] for i in range(100) if not got[i]["base_failed"]]
    assert len(got) == len(rows) and len(clean) > 50 and sum(r["kept"] for r in clean) >= 0.95 * len(clean)
    once = {r["doc_id"]: r for r in perplexity.judged(frame.filter("doc_id <= 1000")).collect()}
    assert all(abs(once[i]["log_ppl"] - got[i]["log_ppl"]) < 1e-4 and once[i]["kept"] == got[i]["kept"] for i in once)
