"""Every query of the engine against its DuckDB counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return str(round(float(x), 9))
    return str(x)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted([tuple(plain(v) or "" for v in row) for row in frame[names].astype(object).itertuples(index=False, name=None)])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    assert rows(ours) == rows(duck.sql(registry.ORACLES[name]).df())


def test_approximate_search_recall(spark):
    """At least nine tenths of what exact search finds; quantised_topk has a test of its own."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"ann_topk", "quantised_topk"}
    folder = SF.replace("0.001", "0.01")
    found, exact = ({(r["query_id"], r["id"]) for r in registry.QUERIES[q](spark, folder).collect()} for q in ("ann_topk", "dense_topk"))
    assert len(found & exact) >= 0.9 * len(exact)
