"""Search over compressed vectors against exact search; what an index holds; awkward points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import quantised
from lodestone.plans import registry

SF = "/root/testdata/sf0.1"


def test_recall_of_the_query(spark):
    found, exact = ({(r["query_id"], r["id"]): r["score"] for r in registry.QUERIES[q](spark, SF).collect()} for q in ("quantised_topk", "dense_topk"))
    assert len(found) == len(exact) and len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(found[k] == pytest.approx(exact[k], abs=2e-6) for k in found.keys() & exact.keys())


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 points around 60 directions, then some without a vector, with a hole, of another size, twice, of length zero."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(60, 30)), 50, 0) + 0.2 * rng.normal(size=(3000, 30))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(4000, None, "c"), (4001, [1.0, None] * 15, "c"), (4002, [1.0], "c"), (5, x[5].tolist(), "c"), (None, x[0].tolist(), "c"), (4003, [0.0] * 30, "c")]
    return spark.createDataFrame(rows, "id long, vector array<double>, code string").repartition(4)


def test_index_is_opened_from_its_path(spark, clustered, tmp_path):
    """Cells grow with the square root of the points, a search looks into few of them, codes are a byte for each part."""
    quantised.build(clustered, str(tmp_path / "index"), parts=10)
    index = quantised.Quantised(spark, str(tmp_path / "index"))
    assert len(index.model.centers) == 55 and index.model.probes < 20
    assert index.codes.count() == index.vectors.count() == 3002 and {len(r["code"]) for r in index.codes.collect()} == {10}
    queries = clustered.filter("id % 50 = 0 AND id < 3000").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = {(r["query_id"], r["id"]) for r in quantised.nearest(index, queries, 10).collect()}
    x = {r["id"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in clustered.filter("id < 3000").collect()}
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    want = {(q["query_id"], int(i)) for q in queries.collect() for i in ids[np.argsort(-(m @ x[q["query_id"]]), kind="stable")[:10]]}
    assert len(got & want) >= 0.95 * len(want)


def test_files_follow_cells(spark, clustered, tmp_path):
    """Points of every cell in each of 16 tasks leave about a file for each cell, not one for each cell and task."""
    index = quantised.build(clustered.repartition(16), str(tmp_path / "index"), parts=4)
    for part in (index.codes, index.vectors):
        assert part.count() == 3002 and len(part.inputFiles()) < 3 * len(index.model.centers)


def test_no_points_and_no_queries(spark, clustered, tmp_path):
    none = quantised.build(clustered.limit(0), str(tmp_path / "none"))
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<double>")
    assert quantised.nearest(none, queries, 3).collect() == []
    full = quantised.build(clustered, str(tmp_path / "full"), parts=4)
    assert quantised.nearest(full, queries.limit(0), 3).collect() == []


def test_scores_by_codes_are_those_of_the_decoded_vectors():
    rng = np.random.default_rng(1)
    x = quantised.unit(rng.normal(size=(400, 10)))
    model = quantised.learned(x, 400, parts=4)
    cell, code = model.encoded(x)
    decoded = model.centers[cell] + np.concatenate([model.patterns[k][code[:, k]] for k in range(4)], 1)[:, :10]
    base, table = model.tables(x[:5])
    by_code = base[:, cell] + sum(table[:, k][:, code[:, k]] for k in range(4))
    assert np.allclose(by_code, x[:5] @ decoded.T)
