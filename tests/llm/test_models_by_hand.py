"""Learned operators against plain Python: features, training step by step, scores, models and bands."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import language_id, perplexity, quality_classifier, toxicity
from lodestone.llm.batches import grams, hashes, pieces

STEMS = ["river", "stone", "house", "under", "the", "old", "wind", "road", "song", "night", "walking", "Émile", "scoundrel", "straße"]


def text_of(rng, n):
    return "".join(rng.choice(STEMS) + rng.choice(["", "s", "7", "ing"]) + rng.choice([" ", " ", " ", ". ", "!\n", ", ", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [(i, text_of(rng, rng.randrange(1, 60)), rng.choice(["en", "fr", "de"])) for i in range(150)]
    return [*out, (150, None, "en"), (151, "", "fr"), (152, " \n", None), (153, "12 34", "en"), (154, out[3][1], "en"), (None, out[4][1], "fr"), (155, "the old the old the " * 400, "de")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score long").repartition(3)


def word(b):
    return int(hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])


class PlainFtrl:
    """One weight at a time, in dictionaries."""

    def __init__(self, alpha, l1, l2, beta=1.0):
        self.a, self.l1, self.l2, self.b, self.z, self.n = alpha, l1, l2, beta, defaultdict(float), defaultdict(float)

    def weight(self, k):
        z = self.z[k]
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.b + math.sqrt(self.n[k])) / self.a + self.l2)

    def update(self, k, w, g):
        n = self.n[k]
        self.z[k] += g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.a * w
        self.n[k] = n + g * g


def logistic(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


# ---------------------------------------------------------------- quality


def quality_features(text):
    own = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9 \t-\r]+", (text or "").encode())
    h = [word(w) for w in own]
    single = list(h)
    for i, w in enumerate(own):
        if re.match(rb"[A-Za-z\x80-\xff]", w):
            if i > 1 and own[i - 2] == w:
                single[i] = int(quality_classifier.AGAIN[1])
            elif i and own[i - 1] == w:
                single[i] = int(quality_classifier.AGAIN[0])
    two = [int(grams(np.array(h[i : i + 2], np.uint64), np.array([0, 2]), 2)[0][0]) for i in range(len(h) - 1)]
    return [x >> (64 - quality_classifier.BITS) for x in [*single, *two]]


def test_quality_by_hand(spark, rows, frame):
    labels = {i: int("scoundrel" in (t or "")) for i, t, _ in rows if i is not None}
    got = {(r["doc_id"], r["held_out"]): r for r in quality_classifier.scored(frame, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    taught = [(labels[i], quality_features(t)) for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    taught.sort(key=lambda x: (x[0], len(x[1]), np.array(x[1][:64], np.uint32).tobytes()))
    model, bias = PlainFtrl(0.3, 0.3, 1.0), PlainFtrl(0.1, 0.0, 0.0)
    order = np.random.default_rng(7)
    for _ in range(quality_classifier.EPOCHS):
        for i in order.permutation(len(taught)):
            y, at = taught[i]
            x = {k: n / math.sqrt(max(1, len(at))) for k, n in Counter(at).items()}
            w, b = {k: model.weight(k) for k in x}, bias.weight(0)
            miss = logistic(sum(w[k] * x[k] for k in x) + b) - y
            for k in x:
                model.update(k, w[k], miss * x[k])
            bias.update(0, b, miss)
    for i, t, _ in rows:
        at = quality_features(t)
        want = logistic(sum(model.weight(k) for k in at) / math.sqrt(max(1, len(at))) + bias.weight(0))
        r = got[i, zlib.crc32(str("" if i is None else i).encode()) % 3 == 1]
        assert r["score"] == pytest.approx(want, abs=1e-5) and r["predicted"] == int(r["score"] >= 0.5)


# ---------------------------------------------------------------- toxicity


def sentences(text):
    """For each sentence its distinct features."""
    out = []
    for part in re.split(r"[.!?\n]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
        own = set()
        for w in re.findall(r"[a-z\x80-\U0010FFFF]+", part):
            for span in [w, *(w[:k] for k in toxicity.PREFIXES if len(w) > k)]:
                own.add(word(span.encode()) >> (64 - toxicity.BITS))
        if own:
            out.append(own)
    return out


def test_toxicity_by_hand(spark, rows, frame):
    labels = {i: int("scoundrel" in (t or "")) for i, t, _ in rows if i is not None}
    got = {r["doc_id"]: r for r in toxicity.scored(frame, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    chosen = [(labels[i], sentences(t)) for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 0]
    (order_of,) = [toxicity.sample(frame, spark.createDataFrame([(i, labels[i]) for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 0], "id long, y int"))]
    assert Counter((y, frozenset(f.tolist())) for y, f, _ in order_of) == Counter((y, frozenset(k for s in ss for k in s)) for y, ss in chosen)
    spread = Counter(k for _, ss in chosen for k in set().union(*ss))
    # the order of training is that of the sample; sets of equal features are interchangeable
    by = defaultdict(list)
    for y, ss in chosen:
        by[y, frozenset(k for s in ss for k in s), len(ss)].append(ss)
    taught = []
    for y, f, s in order_of:
        ss = by[y, frozenset(f.tolist()), len(set(s.tolist()))].pop()
        ss = [own for own in ({k for k in x if spread[k] >= toxicity.LEAST} for x in ss) if own]
        if ss:
            taught.append((y, ss))
    model = PlainFtrl(2.0, 2.0, 0.0)
    order = np.random.default_rng(11)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(taught)):
            y, ss = taught[i]
            w = {k: model.weight(k) for s in ss for k in s}
            p = [logistic(sum(w[k] for k in s) + toxicity.BIAS) for s in ss]
            clean = math.prod(1 - min(x, 1 - 1e-9) for x in p)
            step = defaultdict(float)
            for s, x in zip(ss, p, strict=True):
                for k in s:
                    step[k] += -x * clean / max(1 - clean, 1e-6) if y else x
            for k, g in step.items():
                model.update(k, w[k], g)
    for i, t, _ in rows:
        ss = [{k: model.weight(k) for k in s if model.weight(k)} for s in sentences(t)]
        p = [logistic(sum(s.values()) + toxicity.BIAS) for s in ss]
        over = {frozenset(s): x for s, x in zip(ss, p, strict=True) if x >= toxicity.LOCATED}
        want = max([0.0, 1 - math.prod(1 - min(x, 1 - 1e-9) for x in over.values()), *p])
        assert got[i]["score"] == pytest.approx(want, abs=1e-4)
        assert got[i]["offending"] == [k for k, x in enumerate(p) if x >= toxicity.LOCATED]
        assert got[i]["n_sentences"] == len(p) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_long_clean_texts_stay_clean(spark):
    """However long a text is, sentences without evidence don't add up; one bad sentence still counts."""
    rng = random.Random(4)
    plain = [w for w in STEMS if w != "scoundrel"]

    def text(n, bad=False):
        out = [" ".join(rng.choice(plain) for _ in range(6)) for _ in range(n)]
        if bad:
            out[n // 2] += " scoundrel"
        return ". ".join(out) + "."

    rows = [(i, text(rng.randrange(1, 12), i % 2 == 0)) for i in range(400)]
    long = [(1000 + i, text(10_000, i % 2 == 0)) for i in range(10)] + [(2000 + i, rows[i][1] * 60) for i in range(1, 400, 8)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(spark.createDataFrame(rows + long, "doc_id long, text string"), labels).collect()}
    for i, _ in long:
        assert got[i]["predicted"] == int(i < 2000 and i % 2 == 0)
    assert all(bool(r["offending"]) for r in got.values() if r["predicted"])


# ---------------------------------------------------------------- languages


def letters(text):
    out = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    out = re.sub(" +", " ", out)
    return [out[i : i + n] for n in (1, 2, 3) for i in range(len(out) - n + 1)]


def language_feature(gram):
    v = 0
    for k, c in enumerate(gram):
        v |= ord(c) << (21 * k)
    return ((v * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - language_id.BITS)


def test_languages_by_hand(rows, frame):
    """With the sample's order given, the model and every score follow from plain loops."""
    sample = language_id.sample(frame, 3, 1)
    usable = [(lang, Counter(map(language_feature, letters(t)))) for i, t, lang in rows if lang and t and zlib.crc32(str("" if i is None else i).encode()) % 3 != 1]
    assert Counter((y, frozenset(zip(f.tolist(), n.tolist(), strict=True))) for y, f, n in sample) == Counter((y, frozenset(c.items())) for y, c in usable)
    names = sorted({y for y, _, _ in sample})
    spread = Counter(int(k) for _, f, _ in sample for k in f)
    idf = defaultdict(lambda: math.log(1 + len(sample)) + 1, {k: math.log((1 + len(sample)) / (1 + n)) + 1 for k, n in spread.items()})
    data = []
    for y, f, n in sample:
        total = sum(n.tolist())
        data.append((names.index(y), {k: language_id.SCALE * c / total * idf[k] for k, c in zip(f.tolist(), n.tolist(), strict=True)}))
    order = np.random.default_rng(5).permutation(len(data))
    apart, taught = order[: len(order) // 5], order[len(order) // 5 :]
    model, bias = [PlainFtrl(0.5, 0.5, 0.1) for _ in names], [PlainFtrl(0.1, 0.0, 1.0) for _ in names]

    def softmax(s):
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    shuffle = np.random.default_rng(3)
    for _ in range(language_id.EPOCHS):
        for i in shuffle.permutation(taught):
            y, x = data[i]
            w, b = [{k: m.weight(k) for k in x} for m in model], [m.weight(0) for m in bias]
            p = softmax([sum(own[k] * v for k, v in x.items()) + c for own, c in zip(w, b, strict=True)])
            p[y] -= 1
            for m, own, c, one, g in zip(model, w, b, bias, p, strict=True):
                for k, v in x.items():
                    m.update(k, own[k], v * g)
                one.update(0, c, g)
    raw = [(data[i][0], [sum(m.weight(k) * v for k, v in data[i][1].items()) + one.weight(0) for m, one in zip(model, bias, strict=True)]) for i in apart]
    warm = min(np.geomspace(0.25, 8, 41), key=lambda t: -sum(math.log(max(softmax([x / t for x in s])[y], 1e-12)) for y, s in raw))
    got = defaultdict(list)
    for r in language_id.predicted(frame).collect():
        got[r["doc_id"]].append(r)
    for i, t, _ in rows:
        own = Counter(map(language_feature, letters(t)))
        (r,) = got[i]
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = sum(own.values())
        p = softmax([(sum(m.weight(k) * language_id.SCALE * c / total * idf[k] for k, c in own.items()) + one.weight(0)) / warm for m, one in zip(model, bias, strict=True)])
        assert r["score"] == pytest.approx(max(p), abs=1e-4) and p[names.index(r["lang_pred"])] == pytest.approx(max(p), abs=1e-4)


# ---------------------------------------------------------------- perplexity


def kneser_ney(texts):
    """The probability of a character after its context, from dictionaries of strings."""
    order, least = perplexity.ORDER, perplexity.LEAST
    count = {order: Counter()}
    for t in texts:
        wide = "\0" * (order - 1) + t
        count[order].update(wide[i : i + order] for i in range(len(t)))
    held = {order: {g for g, n in count[order].items() if n >= least}}
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in held[n + 1])
        held[n] = set(count[n])
    total, spared, discount = {}, {}, {}
    for n in count:
        often = Counter(count[n].values())
        n1, n2, n3, n4 = (often[k] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
        discount[n] = [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]
        total[n], spared[n] = Counter(), defaultdict(float)
        for g, c in count[n].items():
            total[n][g[:-1]] += c
        for g in held[n]:
            spared[n][g[:-1]] += count[n][g] - discount[n][min(count[n][g], 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 4096
        if g[:-1] not in spared[n]:
            return p(g[1:])
        all_ = total[n][g[:-1]]
        own = count[n][g] - discount[n][min(count[n][g], 3) - 1] if g in held[n] else 0.0
        return own / all_ + max((all_ - spared[n][g[:-1]]) / all_, 1e-12) * p(g[1:])

    return p


def test_perplexity_by_hand(rows, frame):
    got = defaultdict(list)
    for r in perplexity.judged(frame).collect():
        got[r["doc_id"]].append(r)
    texts = defaultdict(set)
    for _, t, lang in rows:
        if t:
            texts[lang].add(t)
    p = {lang: kneser_ney(own) for lang, own in texts.items()}
    passing = defaultdict(dict)
    for i, t, lang in rows:
        (r,) = got[i]
        if not t:
            assert r["log_ppl"] is None and not r["kept"]
            continue
        wide = "\0" * 4 + t
        assert r["log_ppl"] == pytest.approx(-sum(math.log(p[lang](wide[k : k + 5])) for k in range(len(t))) / len(t), abs=1e-4)
        if not r["base_failed"]:
            passing[lang][t] = r["log_ppl"]
    kept = 0
    for i, t, lang in rows:
        (r,) = got[i]
        if r["base_failed"] or not t:
            assert not r["kept"]
            continue
        bins = sorted(math.floor(x / perplexity.BIN) for x in passing[lang].values())
        low, mid, high = (perplexity.BIN * (bins[math.ceil(q * len(bins)) - 1] + 0.5) for q in (0.25, 0.5, 0.75))
        below, above = max((mid - low) / 0.6745, 0.02), max((high - mid) / 0.6745, 0.02)
        least = mid - perplexity.BELOW * math.sqrt(below**2 + 1 / len(t))
        most = mid + perplexity.ABOVE * math.sqrt(above**2 + 1 / len(t))
        assert (r["least_log_ppl"], r["most_log_ppl"]) == (pytest.approx(least), pytest.approx(most))
        assert r["kept"] == (least <= r["log_ppl"] <= most)
        kept += r["kept"]
    assert kept > 50


def test_both_bands_reject(spark):
    """Junk of random letters lies above its language's band, texts of very few words below."""
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randrange(1, 5))) for _ in range(600)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(300)), "en") for i in range(300)]
    few = sorted(words, key=len)[-6:]
    rows += [(1000 + i, " ".join(rng.choice(few) for _ in range(60)), "en") for i in range(5)]
    rows += [(2000 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(200)), "en") for i in range(5)]
    got = {r["doc_id"]: r for r in perplexity.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i]["kept"] for i in range(300)) >= 297
    below = [got[1000 + i] for i in range(5) if not got[1000 + i]["base_failed"]]
    assert below and all(r["log_ppl"] < r["least_log_ppl"] and not r["kept"] for r in below)
    assert all(got[2000 + i]["log_ppl"] > got[2000 + i]["most_log_ppl"] and not got[2000 + i]["kept"] for i in range(5))


def test_fold_is_exact_for_these_texts(rows):
    (t,) = pieces(pa.array(["aé௿"]))
    key, _ = perplexity.hashed(t)
    assert [int(k) & 0xFFF for k in key] == [ord("a"), ord("é"), 0xBFF]
    assert all(ord(c) < 0xC00 for _, t, _ in rows for c in t or "")
