"""Components within a cluster, and of clusters too large for one task, against all pairs."""

import numpy as np
import pytest

from lodestone.llm import cluster_links, ngram_join


def by_all_pairs(size, rows, percent):
    own, root = [set(r.tolist()) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            o = len(own[i] & own[j])
            if 100 * o >= percent * (size[i] + size[j] - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(own))]


def sets_like(rng, m, chains):
    """Changed copies of some bases (or of each other), some with very common n-grams, some with n-grams of their own."""
    bases = [rng.integers(0, 10**9, rng.integers(4, 60)) for _ in range(max(1, m // 8))]
    rows = []
    for _ in range(m):
        now = (rows[rng.integers(len(rows))].astype(np.int64) if chains and rows and rng.random() < 0.7 else bases[rng.integers(len(bases))]).copy()
        many = int(len(now) * rng.choice([0, 0.05, 0.1, 0.2, 0.3]))
        now[rng.integers(0, len(now), many)] = rng.integers(0, 10**9, many)
        if rng.random() < 0.3:
            now = np.concatenate((now, rng.integers(0, 50, rng.integers(1, 8))))
        rows.append(np.unique(now).astype(np.uint64))
    size = np.array([len(r) for r in rows]) + rng.integers(0, 4, m) * (rng.random(m) < 0.2)
    order = np.argsort(size, kind="stable")
    return size[order], [rows[i] for i in order]


@pytest.mark.parametrize("percent", [60, 75, 90])
@pytest.mark.parametrize("piece", [50, 1 << 21])
def test_solved(monkeypatch, percent, piece):
    monkeypatch.setattr(cluster_links, "PIECE", piece)
    rng = np.random.default_rng(percent)
    for k in range(40):
        size, rows = sets_like(rng, int(rng.integers(1, 120)), k % 2)
        assert cluster_links.solved(size, rows, percent).tolist() == by_all_pairs(size, rows, percent)


def test_lists_skip_by_position():
    """A probe meets only sets that may link, of all that hold its n-grams."""
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate((rng.integers(0, 30, 10), rng.integers(100, 10**6, 30 + i % 200)))).astype(np.uint64) for i in range(400)]
    rows.sort(key=len)
    sets = cluster_links.Sets(np.array([len(r) for r in rows]), rows, 75)
    met = sum(len(a) for a, _ in cluster_links.Lists(sets, np.arange(400), 75).pairs(np.arange(400)))
    held = sum(len(np.intersect1d(a, b)) > 0 for a in rows for b in rows)
    assert met < held / 20


def test_templates_and_copies_in_one_large_cluster(spark):
    """Pages of one template that don't link, groups of copies among them, all over several tasks."""
    rng = np.random.default_rng(7)
    frame = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = [f"p{i}x{k}" for k in range(int(rng.integers(12, 60)))]
        rows.append((i, " ".join(frame + own)))
        if i % 6 == 0:
            for c in range(5):
                changed = own[:]
                changed[c % len(own)] = f"c{c}"
                rows.append((1000 + 10 * i + c, " ".join(frame + changed)))
    from test_sets import links

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs, cluster=300).collect()}
    assert got == set(links(rows))


@pytest.mark.parametrize("share", [1, 2])
def test_frequent_ngrams_are_never_gathered(spark, monkeypatch, share):
    """N-grams that most documents share, some of which consist of little else, with the same result."""
    monkeypatch.setattr(ngram_join, "SAMPLE", share)
    monkeypatch.setattr(ngram_join, "DEAL", 25)
    rng = np.random.default_rng(8)
    frame = [f"t{i}" for i in range(30)]
    rows = []
    for i in range(120):
        own = [f"p{i}x{k}" for k in range(int(rng.choice([0, 1, 3, 8, 30])))]
        rows.append((i, " ".join(frame[: int(rng.integers(20, 31))] + own)))
    rows += [(500 + i, rows[i][1]) for i in range(0, 120, 7)]
    from test_sets import links

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    heavy = ngram_join.frequent(docs, 5, share, 25)
    assert 10 < len(heavy) < 100
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs).collect()}
    assert got == set(links(rows))


def test_thinned_lists_keep_components():
    rng = np.random.default_rng(5)
    for _ in range(50):
        m = int(rng.integers(1, 400))
        token, number, n = rng.integers(0, 4, m).astype(np.uint64), rng.integers(0, 60, m).astype(np.int64) * 1000, rng.integers(1, 200, m).astype(np.uint32)
        n = (number % 7 + n[number // 1000 % m] % 150 + 1).astype(np.uint32)  # a class has one size

        def parts(lists):
            token, number, n = lists
            order = np.lexsort((number, n, token))
            token, number, n = token[order], number[order], n[order].astype(np.int64)
            near = np.flatnonzero((token[1:] == token[:-1]) & (100 * n[:-1] >= 75 * n[1:]))
            a, b = ngram_join.forest(number[near], number[near + 1])
            root = {int(x): int(x) for x in number} | dict(zip(a.tolist(), b.tolist(), strict=True))
            return root

        whole = parts([token, number, n])
        # two tasks, each with half of the rows
        half = rng.random(m) < 0.5
        thin = [np.concatenate(x) for x in zip(*(ngram_join.thinned(token[h], number[h], n[h], 75) for h in (half, ~half)), strict=True)]
        assert parts(thin) == whole
    many = [np.zeros(5000, np.uint64), np.arange(5000), rng.integers(50, 400, 5000).astype(np.uint32)]
    assert (ngram_join.thinned(*many, 75)[0] == 0).sum() < 30
