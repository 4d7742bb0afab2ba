"""The sample of language training: bounded, never without a language, whatever the identifiers are."""

import pytest

from lodestone.llm import language_id

SCHEMA = "doc_id long, text string, lang string, key int, l string"


def sizes(spark, rows):
    found = language_id.sample(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4), 3, 1)
    return {lang: sum(x[0] == lang for x in found) for lang in {x[0] for x in found}}


@pytest.mark.parametrize("doc_id", [8, 9, 11, 17, 20, None])
def test_rows_of_one_identifier(spark, monkeypatch, doc_id):
    """Many texts of one id, or of none: as many as the bound, unless the id is held out."""
    monkeypatch.setattr(language_id, "MOST", 50)
    import zlib

    held_out = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1
    got = sizes(spark, [(doc_id, f"ein Satz mit {'xy' * i}", "de") for i in range(200)] + [(8, f"one with {'ab' * i}", "en") for i in range(30)])
    assert got.get("de", 0) == (0 if held_out else 50)


def test_repeated_rows_count_once_and_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TOTAL", 20)
    rows = [(8, "the same text", "en")] * 500 + [(8, f"text {'q' * i}", "en") for i in range(40)] + [(8, f"wort {k}", f"l{k}") for k in range(30)]
    got = sizes(spark, rows)
    assert set(got) == {"en", *(f"l{k}" for k in range(30))} and set(got.values()) == {1}


def test_chosen_alike_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST", 7)
    rows = [(3 * i if i % 4 else None, f"text {'q' * i}", "en") for i in range(60)]
    a, b = (language_id.sample(spark.createDataFrame([(*r, 1, "x") for r in some], SCHEMA).repartition(n), 3, 1) for some, n in ((rows, 3), (rows[::-1] + rows[:9], 5)))
    assert len(a) == 7 and [(x, f.tolist(), n.tolist()) for x, f, n in a] == [(x, f.tolist(), n.tolist()) for x, f, n in b]
