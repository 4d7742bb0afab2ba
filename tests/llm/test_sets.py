"""Decontamination, mixing and the n-gram join against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import decontamination, mixing, ngram_join
from lodestone.llm.components import components

AZ = {c: c + 32 for c in range(65, 91)}


def hit_words(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    hit, ids = set(), set()
    for i, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(AZ))
        n = min(13, len(own))
        for s in range(len(own) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[s : s + n]:
                    hit |= set(range(p, p + n))
                    ids |= {str(i)} if i is not None else set()
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(words)


def items(awkward):
    base = awkward[8][1].split()
    return [(1, " ".join(base[10:40])), (2, "one"), (3, "A, b; C"), (4, None), (5, "..."), (10, " ".join(base[30:43])), (None, " ".join(base[:14])), (1, " ".join(base[10:40])), (7, "x x x")]


def test_decontamination(spark, awkward, docs):
    bench = spark.createDataFrame(items(awkward), "item_id long, text string")
    got = Counter(tuple(r) for r in decontamination.judged(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == Counter((r[0], *hit_words(r[1], items(awkward))) for r in awkward)


def test_decontamination_in_blocks(spark, awkward, docs, monkeypatch):
    bench = spark.createDataFrame(items(awkward), "item_id long, text string")
    whole = sorted(map(str, decontamination.hits(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "MOST_ANCHORS", 3)
    assert sorted(map(str, decontamination.hits(docs, bench).collect())) == whole


def test_contaminated_documents_and_spans_go(spark, awkward, docs):
    bench = spark.createDataFrame(items(awkward), "item_id long, text string")
    kept = decontamination.without_documents(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in awkward if not hit_words(r[1], items(awkward))[4])
    for r in decontamination.without_spans(docs, bench).collect():
        before = next(x[1] for x in awkward if x[0] == r["doc_id"])
        n, hit = hit_words(before, items(awkward))[:2]
        assert (r["text"] is None) == (before is None)
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r["text"] or "")) == n - hit


def test_decontamination_of_nothing(spark, docs, none, awkward):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.judged(none, empty).count() == 0
    assert decontamination.judged(docs, empty).filter("contaminated or n_hit > 0").count() == 0
    assert decontamination.judged(docs, empty).count() == len(awkward)


def test_mixing(docs, awkward):
    got = mixing.mix(docs).collect()
    assert len(got) == len(awkward)
    size = {}
    for r in awkward:
        size.setdefault(r[3], 0)
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(size.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        for s in over or free:
            target[s] = 3 * size[s] if over else share[s]
            left -= target[s]
        free -= over or set(free)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert Counter(map(str, got)) == Counter(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixed_repeats_rows(docs):
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +want


def test_mixing_of_nothing(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def links(rows, percent=75, n=5):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(sets[i][0])
    return Counter((i, len(s), min((x for x in groups[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("cluster", [ngram_join.CLUSTER, 40])
def test_ngram_join(docs, awkward, cluster):
    got = ngram_join.linked(docs, cluster=cluster)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == links([(r[0], r[1]) for r in awkward])


def test_chains_of_near_copies(spark):
    """Neighbours link, ends don't: the answers of pivots alone would not do."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    rows, now = [], words[:]
    for i in range(60):
        rows.append((i, " ".join(now)))
        now = now[:]
        for _ in range(2):
            now[rng.integers(len(now))] = f"n{rng.integers(10**6)}"
    rows += [(100 + i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(20)]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), cluster=500)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == links(rows)


def test_one_of_each(docs, awkward):
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    heads = {c for _, _, c in links([(r[0], r[1]) for r in awkward])}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(heads)


def test_join_of_nothing(none):
    assert ngram_join.linked(none).count() == 0 and ngram_join.one_of_each(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(71)} | {(200, 200), (201, 200)}
