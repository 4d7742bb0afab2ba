"""The pipeline against plain Python: each stage on awkward rows, all of run(), files that stay."""

import glob
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lodestone.llm import language_id, shared
from lodestone.llm.queries import vocabulary
from test_sets import AZ, hit_words, links

SF = "/root/testdata/sf0.001"
CALLED = dict(corpus_pipeline.STAGES)


def key(row):
    return tuple(row)


def languages_by_hand(rows, score):
    """score: (language, probability) of each text, as the model has them."""
    out = []
    for r in rows:
        lang, p = score[r["text"]]
        if lang != "und" and p >= 0.5:
            out.append(r.asDict() | {"lang": lang if r["lang"] is None else r["lang"]})
    return out


def copies_by_hand(rows):
    """One row of each component, by all pairs; which one only matters by its component."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(AZ))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    met = Counter((i, j) for own in by.values() for k, i in enumerate(own) for j in own[:k])
    for (i, j), o in met.items():
        if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return list(groups.values())


def mixed_by_hand(rows):
    """How often each row is taken, with thresholds found by sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r["source"]] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(size)), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        for s in over or free:
            target[s] = 3 * total[s] if over else share[s]
            left -= target[s]
        free -= over or set(free)
    out = [0] * len(rows)
    for s in names:
        whole = int(target[s] // max(1, total[s]))
        rest = target[s] - whole * total[s]
        bars = Counter()
        for i, r in enumerate(rows):
            if r["source"] == s:
                out[i] = whole
                bars[hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:9]] += size[i]
        taken, upto = set(), 0
        for h in sorted(h for h, n in bars.items() if n):
            if upto + bars[h] > rest:
                if bars[h] - (rest - upto) <= rest - upto:
                    taken.add(h)
                break
            upto += bars[h]
            taken.add(h)
        last = max(taken, default="")
        for i, r in enumerate(rows):
            h = hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:9]
            out[i] += r["source"] == s and taken != set() and h <= last
    return out


def tokens_by_hand(rows):
    tokenizer, start, out = Tokenizer.from_file(vocabulary()), 0, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def scores(docs):
    """What the operator predicts for each text; held against plain Python in test_models_by_hand."""
    tagged = language_id.tagged(docs.select("text"), language_id.learned(docs), ("l", "p"))
    return {r["text"]: (r["l"], r["p"]) for r in tagged.collect()}


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = languages_by_hand(docs.collect(), scores(docs))
    heads = [min(group, key=lambda r: r["doc_id"]) for group in copies_by_hand(rows)]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r in heads if not hit_words(r["text"], items)[4]]
    assert len(rows) > len(heads) > len(clean)
    taken = [r for r, n in zip(clean, mixed_by_hand(clean), strict=True) for _ in range(n)]
    want = tokens_by_hand(taken)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


@pytest.fixture(scope="module")
def strange(spark, awkward):
    """Awkward rows in the columns of documents, and one more that stages use inside."""
    return spark.createDataFrame([(*r[:5], "x", 1) for r in awkward], "doc_id long, text string, lang string, source string, n_chars long, label string, cls int").repartition(3).cache()


def test_language_stage(spark, strange):
    got = CALLED["language ID"](spark, strange, SF)
    assert got.columns == strange.columns
    want = languages_by_hand(strange.collect(), scores(strange))
    assert Counter(map(key, got.collect())) == Counter(tuple(r[c] for c in strange.columns) for r in want)
    assert all(r["lang"] is not None and r["text"].strip() for r in got.collect())


def test_join_stage(spark, strange):
    got = CALLED["n-gram Jaccard join"](spark, strange, SF)
    assert got.columns == strange.columns
    kept = got.collect()
    groups = copies_by_hand(strange.collect())
    left = Counter(map(key, kept))
    for group in groups:
        own = [r for r in group if left[key(r)]]
        if (group[0]["text"] or "").strip():
            assert len({key(r) for r in own}) == 1
            first = min((r["doc_id"] for r in group if r["doc_id"] is not None), default=None)
            assert own[0]["doc_id"] == first
    assert {r["doc_id"] for r in kept} == {c for _, _, c in links([(r["doc_id"], r["text"]) for r in strange.collect()])}


def test_decontamination_stage(spark, strange, awkward, tmp_path):
    base = awkward[8][1].split()
    items = [(1, " ".join(base[10:40])), (2, "one"), (4, None), (None, " ".join(base[:14]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = CALLED["benchmark decontamination"](spark, strange, f"file://{tmp_path}")
    assert got.columns == strange.columns
    assert Counter(map(key, got.collect())) == Counter(key(r) for r in strange.collect() if not hit_words(r["text"], items)[4])


def test_mixing_stage(spark, strange):
    got = CALLED["mixing sources"](spark, strange, SF)
    assert got.columns == strange.columns
    rows = strange.collect()
    assert Counter(map(key, got.collect())) == +Counter({k: n for k, n in sum_of(rows, mixed_by_hand(rows))})


def sum_of(rows, times):
    out = Counter()
    for r, n in zip(rows, times, strict=True):
        out[key(r)] += n
    return out.items()


def test_token_stage_keeps_its_files(spark, strange, tmp_path):
    spark.conf.set(corpus_pipeline.OUTPUT, f"file://{tmp_path}/out")
    try:
        with shared.temporary(spark):
            got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in CALLED["token shards"](spark, strange, SF).collect())
    finally:
        spark.conf.unset(corpus_pipeline.OUTPUT)
    assert got == sorted((i is not None, i or 0, n, crc) for i, _, n, crc in tokens_by_hand(strange.collect()))
    assert glob.glob(f"{tmp_path}/out/tokens-*/*.sst")


@pytest.mark.parametrize("name", list(CALLED))
def test_stages_of_nothing(spark, strange, name):
    out = CALLED[name](spark, strange.limit(0), SF)
    assert out.count() == 0 and (name == "token shards" or out.columns == strange.columns)


def test_temporary_tables_go(spark):
    import os

    with shared.temporary(spark):
        inner = shared.shared_table(spark.range(3), "goes")
        with shared.temporary(spark):
            shared.shared_table(spark.range(3), "goes")
            outer = shared.shared_table(spark.range(3), "stays", outer=2)
        assert inner.count() == 3
    paths = [df.inputFiles()[0].removeprefix("file://") for df in (inner, outer)]
    assert [os.path.exists(p) for p in paths] == [False, True] and outer.count() == 3


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
