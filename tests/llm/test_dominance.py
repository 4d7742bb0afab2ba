"""Dominance counts against every pair, on awkward rows, cut into many runs and bands."""

import datetime
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import dominance

SCHEMA = "sale_id long, sold_at timestamp_ntz, total double, slot string, level int, w string, n long, run int, band int, s int"
DAY = datetime.datetime(2024, 3, 30)


def sales(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = rng.choice([DAY, DAY, DAY + datetime.timedelta(minutes=rng.randrange(9000)), datetime.datetime(1969, 12, 31, 22, 59, 59, 500000), None if rng.random() < 0.2 else DAY])
        total = rng.choice([0.0, 1.005, 0.995, 19.994999, 19.995, 20.0, -0.5, -1.0, round(rng.random() * 40, 2), None if rng.random() < 0.3 else 5.0])
        out.append((i if rng.random() < 0.95 else None, at, total))
    return out + out[: n // 10]


def brute(rows):
    keys = []
    for i, at, total in rows:
        slot = None if at is None else int((at - datetime.datetime(1970, 1, 1)).total_seconds() // 3600)
        level = None if total is None or not np.isfinite(total) else int(np.floor(np.floor(100 * total + 0.5) / 100))
        keys.append((slot, level, 1 + zlib.crc32(b"" if i is None else str(i).encode()) % 2))
    out = []
    for (i, _, _), (slot, level, _) in zip(rows, keys, strict=True):
        if slot is None or level is None:
            out.append((i, slot, level, None, None))
        else:
            above = [w for s, v, w in keys if s is not None and v is not None and s <= slot and v > level]
            out.append((i, slot, level, len(above), sum(above)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("run", [20, dominance.RUN])
def test_against_all_pairs(spark, run):
    rows = [*sales(run, 250), (-3, DAY, float("nan")), (-4, DAY, float("inf"))]
    got = dominance.dominated(frame(spark, rows), run)
    assert dict(got.dtypes) == {"sale_id": "bigint", "slot": "bigint", "level": "bigint", "n_sales": "bigint", "n_rows": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_slot_and_one_level(spark):
    """All in one slot, or all of one level, in more runs than one."""
    for rows in ([(i, DAY, float(i % 90)) for i in range(300)], [(i, DAY + datetime.timedelta(hours=i % 90), 7.0) for i in range(300)]):
        assert sorted(map(tuple, dominance.dominated(frame(spark, rows), 10).collect()), key=str) == brute(rows)


def test_session_zone_does_not_matter(spark):
    rows = [(i, datetime.datetime(2024, 3, 10, h, 30), 1.0 + h) for i, h in enumerate(range(5))] + [(9, datetime.datetime(2024, 3, 31, 2, 30), 0.0)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(map(tuple, dominance.dominated(frame(spark, rows)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == brute(rows)


def test_no_rows_and_only_nulls(spark):
    assert dominance.dominated(frame(spark, [])).collect() == []
    assert [r["n_sales"] for r in dominance.dominated(frame(spark, [(1, None, 1.0), (2, DAY, None)])).collect()] == [None, None]


def test_merge_in_memory():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 8, 9, 64, 65, 700):
        rank, w = rng.permutation(n), rng.integers(1, 5, n)
        assert dominance.credits(rank, [w])[0].tolist() == [int(w[:i][rank[:i] > rank[i]].sum()) for i in range(n)]
