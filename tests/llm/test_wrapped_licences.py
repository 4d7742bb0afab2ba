"""Licence sentences as real headers have them: wrapped, behind comment marks, with cuts inside."""

import textwrap

import duckdb
import pandas as pd
import pytest

from lodestone.llm import licences, oracles

FORMS = {
    "one line": lambda t: t,
    "wrapped": lambda t: textwrap.fill(t, 72),
    "hashes": lambda t: textwrap.fill(t, 72, initial_indent="# ", subsequent_indent="# "),
    "stars": lambda t: "/*\n" + textwrap.fill(t, 72, initial_indent=" * ", subsequent_indent=" * ") + "\n */",
    "slashes": lambda t: textwrap.fill(t, 40, initial_indent="// ", subsequent_indent="// ").replace("\n", "\r\n"),
    "dnl": lambda t: textwrap.fill(t, 72, initial_indent="dnl ", subsequent_indent="dnl "),
}


@pytest.mark.parametrize("form", FORMS)
def test_every_sentence_and_rule_is_found(spark, form):
    put = FORMS[form]
    single = [(i, f"Some name\n{put(text)}\ncode = 1", name) for i, (name, text) in enumerate(licences.SENTENCES.items())]
    rules = [(1000 + i, "Some name\n" + put(" ".join(licences.SENTENCES[k] for k in names)), name) for i, (name, names) in enumerate(licences.RULES)]
    if form != "one line":  # a licence in paragraphs
        rules += [(2000 + i, "\n\n".join(put(licences.SENTENCES[k]) for k in names), name) for i, (name, names) in enumerate(licences.RULES)]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([x[:2] for x in single + rules], "doc_id long, text string")).collect()}
    assert {name: got[i]["sentence_ids"] for i, _, name in single} == {name: name for _, _, name in single}
    assert [(i, got[i]["licences"], got[i]["left_over"]) for i, _, _ in rules] == [(i, name, "") for i, _, name in rules]
    by_sql(got, [x[:2] for x in single + rules])


def by_sql(got, rows):
    """The SQL, which finds sentences by their words, says the same."""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.execute(oracles.licences()).fetchall()
    assert {r[0]: r[1:] for r in want} == {i: tuple(r)[1:] for i, r in got.items()}


def test_parts_of_longer_sentences_are_none(spark):
    texts = ["It is not\nreleased under the MIT License, they say.", "Not released under the MIT License.", "a | Released under the MIT License.|b"]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licences"] for r in got] == ["", "", ""]
    by_sql({r["doc_id"]: r for r in got}, list(enumerate(texts)))
