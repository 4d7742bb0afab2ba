"""Classifiers, language identification, perplexity rules: counts against brute force, models held out."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import language_id, perplexity, quality_classifier, toxicity
from lodestone.llm.batches import grams, hashes, pieces, words

SF = "/root/testdata/sf0.1"


def held(i, by):
    return zlib.crc32(str(i).encode()) % by


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_words_and_hashes_do_not_depend_on_neighbours(awkward):
    texts = [r[1] for r in awkward]
    seen = {}
    for texts_now in (texts, texts[::-1], texts[5:9]):
        for t in pieces(pa.array(texts_now, pa.string())):
            starts, ends = words(t)
            h, bounds = hashes(t.data, starts, ends), t.counts(starts)
            g, g_bounds = grams(h, bounds, 3)
            for i in range(t.n):
                text = texts_now[t.first + i] or ""
                own = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
                assert [t.data[a:b].tobytes() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)] == own
                assert g_bounds[i + 1] - g_bounds[i] == max(0, len(own) - 2)
                for w, x in zip(own, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                    assert seen.setdefault(w, x) == x
                for k, x in enumerate(g[g_bounds[i] : g_bounds[i + 1]].tolist()):
                    assert seen.setdefault(tuple(own[k : k + 3]), x) == x
    assert len(set(seen.values())) == len(seen)


def counts_of(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
    repeat = {p for k in range(len(own) - 4) if windows[tuple(own[k : k + 5])] > 1 for p in range(k, k + 5)}
    return [len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)]


def test_base_counts(awkward):
    texts = [r[1] for r in awkward] + ["a\nb\na \na\n\n \na", "x y z " * 9, "#*$ %&|<> é\n#*$ %&|<> é"]
    for t in pieces(pa.array(texts, pa.string())):
        got = np.array(perplexity.counts(t)).T.tolist()
        assert got == [counts_of(texts[t.first + i]) for i in range(t.n)]


def test_kneser_ney_probabilities_add_up():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(200))) for _ in range(30)]
    (t,) = pieces(pa.array(texts))
    key, _ = perplexity.hashed(t)
    model = perplexity.Model(*np.unique(key, return_counts=True))
    for context in (key[57], key[300], np.uint64(0x123456789)):
        every = (np.uint64(context) & ~np.uint64(0xFFF) | np.arange(4096, dtype=np.uint64)) & np.uint64((1 << 60) - 1)
        assert math.isclose(np.exp(model.log_p(every)).sum(), 1, rel_tol=1e-3)


def test_perplexity_rules(spark, docs, none, awkward):
    got = perplexity.judged(docs).collect()
    want = Counter((r[0], *counts_of(r[1])) for r in awkward)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert perplexity.judged(none).count() == 0


def test_perplexity_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(2)
    stems = ["river", "stone", "house", "under", "the", "old", "wind", "road", "song", "night"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "s", "ed", str(rng.randrange(99))]) for _ in range(150)), "en") for i in range(200)]
    rows.append((1000, "".join(rng.choice("qxzjkvw ") for _ in range(900)), "en"))
    got = {r["doc_id"]: r for r in perplexity.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[1000]["base_failed"] and not got[1000]["kept"]
    assert sum(got[i]["kept"] for i in range(200) if not got[i]["base_failed"]) >= 0.97 * sum(not got[i]["base_failed"] for i in range(200)) > 100


def check_contract(rows, docs_rows, by, out):
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in docs_rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % by == out)
        assert 0 <= r["score"] <= 1


def test_quality(tables):
    docs, labels = tables
    got = quality_classifier.scored(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert (got["predicted"] == (got["score"] >= 0.5)).all()


def test_toxicity(tables):
    docs, labels = tables
    got = toxicity.scored(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"][got["toxic"] == 1] == 1).mean() > 0.75 and (got["predicted"][got["toxic"] == 0] == 0).mean() > 0.98


def test_toxic_sentences_are_located(spark):
    rng = random.Random(4)

    def text(bad):
        out = [" ".join(rng.choice(["river", "stone", "house", "the", "old"]) for _ in range(6)) for _ in range(8)]
        if bad is not None:
            out[bad] += " scoundrel"
        return ". ".join(out) + "."

    bad = [rng.choice([None, rng.randrange(8)]) for _ in range(300)]
    docs = spark.createDataFrame([(i, text(b)) for i, b in enumerate(bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b is not None)) for i, b in enumerate(bad)], "doc_id long, toxic int")
    for r in toxicity.scored(docs, labels).filter("held_out").collect():
        assert r["offending"] == ([] if bad[r["doc_id"]] is None else [bad[r["doc_id"]]])


def test_languages(tables):
    docs, _ = tables
    got = language_id.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.98


def test_awkward_rows(spark, docs, none, awkward):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, 0.1) for i in range(40)] + [(3, None, 1, 0.1), (None, 1, 1, 0.1), (4, 1, 1, 0.1)], "doc_id long, quality int, toxic int, score double")
    for module, by, out in ((quality_classifier, 3, 1), (toxicity, 5, 0)):
        check_contract(module.scored(docs, labels).collect(), awkward, by, out)
        check_contract(module.scored(docs, labels.limit(0)).collect(), awkward, by, out)
        assert module.scored(none, labels).count() == 0
    got = language_id.predicted(docs).collect()
    check_contract(got, awkward, 3, 1)
    text = {r[0]: r[1] for r in awkward if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text[r["doc_id"]] or ""))
    assert language_id.predicted(none).count() == 0
