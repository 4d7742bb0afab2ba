"""The audit against whole numbers of plain Python, on awkward rows and small chunks."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    docs = [((lang or ""), (source or ""), TERM.findall(lower(text or ""))) for text, lang, source in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in seen.items()}
    out = []
    for lang in {d[0] for d in docs}:
        v, groups = len(kept[lang]), sorted(s for k, s in counts if k == lang)

        def share(c, v=v, lang=lang):
            n = sum(c[t] for t in kept[lang])
            return [1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept[lang]]

        p = {s: share(counts[lang, s]) for s in groups}
        q = share(sum((counts[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[t], strict=True)), t) for t in groups if t != s]
            terms = [(a - b, t) for a, b, t in zip(p[s], q, kept[lang], strict=True) if counts[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, x, i) for i, (x, t) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("chunk, block, top", [(4096, 1 << 21, 50), (3, 8, 2)])
def test_against_plain_python(spark, docs, awkward, monkeypatch, chunk, block, top):
    monkeypatch.setattr(divergence, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(divergence, "CELLS", block)
    got = divergence.audited(docs, 4, top)
    assert [c for c, _ in got.dtypes] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute([(r[1], r[2], r[3]) for r in awkward], 4, top)


def test_ties_languages_and_terms_beyond_ascii(spark):
    texts = [("über STRASSE Ünder straße 国 𝔘 a_b x1y", "de", s) for s in "abc"] * 3 + [("国 é z", "zh", None), ("z", "zh", ""), (None, None, "only"), ("", "void", "p"), ("", "void", "q"), ("rare", "void", "r")]
    for least in (1, 3, 100):
        frame = spark.createDataFrame(texts, "text string, lang string, source string").repartition(3)
        assert sorted(map(tuple, divergence.audited(frame, least, 3).collect())) == brute(texts, least, 3)


def test_no_documents(spark, none):
    assert divergence.audited(none).collect() == []


def test_shares_of_huge_counts():
    count, total = np.array([0, 10**13, 3 * 10**14]), np.array(4 * 10**14)
    assert divergence.shares(count, total, 9).tolist() == [1 + 10**9 * (int(c) + 5) // (4 * 10**14 + 45) for c in count]
