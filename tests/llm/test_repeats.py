"""Removal of repeated passages against a search of every window; the index against plain comparison."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import repeats
from lodestone.llm.run_index import RunIndex, suffix_order

N = repeats.LENGTH


def brute(rows):
    """rows of (doc_id, text), ids distinct or the rows equal."""
    docs = sorted({(i is None, i or 0, (t or "").encode()) for i, t in rows}, key=lambda d: d[:2])
    seen, out = set(), {}
    for late, i, data in docs:
        gone = bytearray(len(data))
        for at in range(len(data) - N + 1):
            window = data[at : at + N]
            if window in seen:
                gone[at : at + N] = b"\1" * N
            seen.add(window)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[late, i] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return sorted(((i, *out[i is None, i or 0]) for i, _ in rows), key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a", "naïve", "国国", "and so on", "x", "\0", "zebra\n"]) + (str(rng.randrange(99)) if rng.random() < 0.3 else "")
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(rng.randrange(20, 60)) for _ in range(6)]
    out = [None, "", "short", "ab" * 300, "ab" * 40 + "c" + "ab" * 70, "y" * 99, "y" * 100, "y" * 101, fresh(9) + "z" * 500, fresh(3000), "é" * 260]
    for _ in range(50):
        parts = [fresh(rng.randrange(12)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 3)
            parts.insert(rng.randrange(len(parts) + 1), p[a : len(p) - rng.randrange(0, len(p) // 3)])
        out.append(rng.choice(["", " "]).join(parts))
    near = out[9]
    out += [near, near[:4000] + "#" + near[4001:], near[50:], "§" + near[300:2000] + near[100:1500]]
    order = list(range(len(out)))
    rng.shuffle(order)
    rows = [(i - 5, out[k]) for i, k in enumerate(order)]
    return [*rows, rows[3], rows[20], (None, near[100:3000])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, id int, th string, marks int, start int").repartition(5)


def digest(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed, settings", [(1, {}), (2, {"MANY": 1}), (3, {"MANY": 3, "BUCKET": 2000, "FLUSH": 50, "PART": 5000}), (4, {"SAMPLE": 1, "HOT": 1, "BLOCK": 1500})])
def test_against_every_window(spark, monkeypatch, seed, settings):
    for name, value in settings.items():
        monkeypatch.setattr(repeats, name, value)
    rows = texts(seed)
    assert digest(repeats.cut_out(frame(spark, rows))) == brute(rows)


def test_one_id_or_none_for_several_texts(spark):
    """Different texts of one id, or without, are documents one behind another; exactly one of them keeps what they share."""
    shared = " ".join(f"w{i}" for i in range(60))
    for i in (None, 7):
        rows = [(i, f"{shared} {x}") for x in "abc"] * 2
        got = digest(repeats.cut_out(frame(spark, rows)))
        assert sorted(r[2] for r in got) == [0, 0, *[len(shared) + 1] * 4]


def test_no_documents(spark, none):
    assert repeats.cut_out(none).collect() == []


def test_suffix_order_and_matching_statistics():
    rng = np.random.default_rng(4)
    for letters in (1, 2, 4, 250):
        texts = [rng.integers(0, letters, n).astype(np.uint8) for n in (0, 1, 3, 40, 200)]
        texts += [texts[4][20:90], np.tile(texts[3], 5)]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        index = RunIndex(np.concatenate(texts), bounds)
        symbols = index.symbols[: bounds[-1] + len(texts)]
        whole = [tuple(symbols[k:]) for k in range(len(symbols))]
        assert suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=lambda k: whole[k])
        patterns = [rng.integers(0, letters + 1, n).astype(np.uint8) for n in (0, 1, 90)] + [np.concatenate((texts[4][5:150], texts[3]))]
        ends = np.concatenate(([0], np.cumsum([len(p) for p in patterns])))
        got = index.matching(np.concatenate(patterns), ends)
        held = [t.tobytes() for t in texts]
        for p, begin in zip(patterns, ends, strict=False):
            for k in range(len(p)):
                assert got[begin + k] == max(n for n in range(len(p) - k + 1) if any(p[k : k + n].tobytes() in h for h in held))
