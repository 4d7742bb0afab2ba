"""Pseudonyms: every form keeps its validation, dates and phones stay linked, whole tables against plain Python."""

import datetime
import random
import re

import pytest

from lodestone.llm import pseudonyms
from lodestone.llm.queries import KEY


def new(kind, value, back=False):
    return pseudonyms.pseudonym(kind, value, KEY, back)


def test_phones_stay_assigned():
    rng = random.Random(1)
    good = [f"{rng.choice(pseudonyms.AREAS)}-{rng.choice(pseudonyms.AREAS)}-{rng.randrange(10**4):04d}" for _ in range(1000)]
    for value in good:
        out = new("phone", value)
        assert re.fullmatch(r"[2-9]\d\d-[2-9]\d\d-\d{4}", out) and not re.search(r"(^|-)\d11-", out)
        assert new("phone", out, back=True) == value
    assert len({new("phone", v) for v in good}) == len(set(good))
    assert pseudonyms.replaced("000-000-0000 911-555-0100 200-111-0100", KEY)[1] == {}
    odd = "+1 (017) 555-7713"
    out = new("phone", odd)
    assert out != odd and out.startswith("+1 (") and not pseudonyms.assigned(int(re.sub(r"\D", "", out)[1:])) and new("phone", out, back=True) == odd


@pytest.mark.parametrize("kind,value", [("date", "12/31/2024"), ("date", "31/12/2024"), ("date", "31.12.2024"), ("date", "2024-12-31"), ("phone", "917 555 7713"), ("ssn", "123 45 6789"), ("ssn", "123-45-6789")])
def test_forms_are_found_and_invert(kind, value):
    text, seen = pseudonyms.replaced(f"on {value}, so", KEY)
    assert seen == {kind: 1} and text == f"on {new(kind, value)}, so" and value not in text
    assert pseudonyms.replaced(text, KEY, True)[0] == f"on {value}, so"


def test_a_date_has_one_pseudonym_in_all_forms():
    rng = random.Random(2)
    for _ in range(300):
        day = datetime.date.fromordinal(rng.randrange(pseudonyms.FIRST_DAY, pseudonyms.LAST_DAY + 1))
        out = datetime.date.fromisoformat(new("date", day.isoformat()))
        assert (out.day > 12) == (day.day > 12)
        for form in ("%d.%m.%Y", "%d/%m/%Y", *(["%m/%d/%Y"] if day.day > 12 else [])):
            assert new("date", day.strftime(form)) == out.strftime(form)


def test_rows_of_numbers_are_no_values():
    for text in ("12 345 67 8901 5", "1 917 555 7713 23", "13/13/2024", "02/30/2024", "12.31.2024", "31/12-2024"):
        assert pseudonyms.replaced(text, KEY) == (text, {})


def test_whole_table_against_plain_python(spark):
    """Each document's values found by an own loop over single words and replaced one by one."""
    rng = random.Random(3)
    values = ["4111111111111111", "23.4.5.6", "2024-02-29", "123-45-6789", "917-555-7713", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "a.b@mail.example.com", "DE89370400440532013000"]
    kinds = ["card", "ip", "date", "ssn", "phone", "secret", "email", "iban"]
    plain = ["river", "stone", "12", "4111111111111112", "000-12-3456", "999.1.1.1", "x@y", ""]
    rows = [(i, ", ".join(rng.choice(values + plain * 3) for _ in range(rng.randrange(40))) if i % 9 else None, 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_card int").repartition(4)
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(docs, KEY).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        words = [] if text is None else text.split(", ")
        out = ", ".join(new(kinds[values.index(w)], w) if w in values else w for w in words)
        assert got[i]["text"] == (None if text is None else out)
        for kind, value in zip(kinds, values, strict=True):
            assert got[i][f"n_{kind}"] == words.count(value)
        assert got[i]["n_values"] == sum(w in values for w in words)
    back = pseudonyms.pseudonymised(docs.select("doc_id", "text"), KEY)
    inverse = pseudonyms.pseudonymised(back.select("doc_id", "text"), KEY, back=True)
    assert {r["doc_id"]: r["text"] for r in inverse.collect()} == {i: t for i, t, _ in rows}
