"""Pseudonyms of values that stand beside other numbers and words."""

import pytest

from lodestone.llm import pseudonyms
from lodestone.llm.queries import KEY

CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
LONG = "GB82 WEST 1234 5698 7654 32"  # 22 characters
FOUR = "PL61 1090 1014 0000 0712 1981 2874"  # a multiple of four


@pytest.mark.parametrize(
    "form",
    ["{} 123", "{} 12/27", "3 {}", "12345 {} 99", "no {}, 7 8 9", "31.02.1999 {}", "2024-13-45 {} 123"],
)
@pytest.mark.parametrize("card", [CARD, CARD.replace(" ", ""), CARD.replace(" ", "-"), "3782 822463 10005"])
def test_cards_beside_numbers(form, card):
    got, seen = pseudonyms.replaced(form.format(card), KEY)
    assert (got, seen) == (form.format(pseudonyms.pseudonym("card", card, KEY)), {"card": 1})


@pytest.mark.parametrize("form", ["{} EUR", "{} 12", "{} BIC 1234", "AB12 {}", "{}"])
@pytest.mark.parametrize("iban", [FOUR, IBAN, LONG])
def test_ibans_beside_words(form, iban):
    assert pseudonyms.replaced(form.format(iban), KEY) == (form.format(pseudonyms.pseudonym("iban", iban, KEY)), {"iban": 1})


def test_two_cards_and_other_kinds():
    def new(kind, value):
        return pseudonyms.pseudonym(kind, value, KEY)

    other, phone = "5500 0000 0000 0004", "917-555-7713"
    text = "1 {} {} 9 {} 5"
    assert pseudonyms.replaced(text.format(CARD, phone, other), KEY) == (text.format(new("card", CARD), new("phone", phone), new("card", other)), {"card": 2, "phone": 1})


def test_long_runs_of_numbers_take_no_square_of_time():
    text = "12 " * 100_000
    assert pseudonyms.replaced(text, KEY)[0].count(" ") == 100_000
