"""PII: format-preserving pseudonyms.

Numbers and dates that pass their validation are replaced by others of the same format, by a keyed
permutation of the format's values: an unbalanced Feistel network (eight rounds of BLAKE2b) over two
factors of the value's range, walked on until it lands within the range.  So equal values get equal
pseudonyms in all documents, different ones different, and the key's holder can invert them.

Formats and their validation: payment cards (13 to 19 digits, Luhn), IBANs (mod 97), IPv4 addresses
(octets to 255), North American phone numbers (area and exchange in 200 to 999 without N11), US social
security numbers (area and group in use), dates (ISO, day-first, or month-first where the day is over
12; days that exist, 1900 to 2099), e-mail addresses (the local part) and hexadecimal secrets (32
characters or more, with digits and letters).  Punctuation, letter case and length stay; check digits
are made right again, and a pseudonym passes the validation that its value passed.  Ten digits behind
+1 whose area or exchange isn't assigned are a phone number all the same; their pseudonym isn't
assigned either.  Days over 12 stay over 12, so a date has one pseudonym however it is written.

A match that fails its validation may hold a value beside other numbers or words (a card before its CVV
or expiry date, behind a list number).  Of a card's run of digit groups all spans of whole groups that
are grouped as cards are (SHAPES) are tried, the longest first; an IBAN is tried with fewer groups; then the
other kinds and later starts.

The key has no default: who has it can invert every pseudonym.

Defined cases: a null text stays null; a text without any value is returned as it is; repeated rows
and values get the same pseudonyms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import pieces

ROUNDS = 8
KINDS = ("card", "iban", "ip", "phone", "ssn", "date", "email", "secret")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

FOUND = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d-]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d-])(?<!\d )\d{3} \d{2} \d{4}(?![\d-]| \d))"
    r"|(?P<phone>(?<!\d)(?:\+1[ .-]?)?(?:\(\d{3}\) ?|(?<=\+1[ .-])\d{3}[ .-]|(?<![\d-])\d{3}[.-])\d{3}[ .-]\d{4}(?![\d-])|(?<![\d-])(?<!\d )\d{3} \d{3} \d{4}(?![\d-]| \d))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))"
)

EACH = [(part[4 : part.index(">")], re.compile(part)) for part in re.split(r"\|(?=\(\?P<)", FOUND.pattern)]
OTHERS = re.compile("|".join(pattern.pattern for kind, pattern in EACH if kind != "card"))
RUN = re.compile(r"\d+(?:[ -]\d+)*")
# how cards are printed: sizes of their groups
SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3)} | {(n,) for n in range(13, 20)}


def permuted(value: int, size: int, tweak: bytes, key: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size); back inverts it."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = max(8, (max(a, b).bit_length() + 7) // 8 + 8)

    def f(i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d:%d:%d:" % (i, size, x) + tweak, key=key[:64], digest_size=min(64, width)).digest(), "big")

    while True:
        left, right = divmod(value, b)
        if back:
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - f(i, left)) % b
                else:
                    left = (left - f(i, right)) % a
        else:
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + f(i, left)) % b
                else:
                    left = (left + f(i, right)) % a
        value = left * b + right
        if value < size:
            return value


def walked(value: int, size: int, tweak: bytes, key: bytes, back: bool, inside) -> int:
    """The keyed permutation of those values below size for which inside is true."""
    while not inside(value := permuted(value, size, tweak, key, back)):
        pass
    return value


AREAS = [n for n in range(200, 1000) if n % 100 != 11]  # area codes and exchanges that may be assigned
AREA_AT = {n: i for i, n in enumerate(AREAS)}


def assigned(number: int) -> bool:
    """Whether a North American number of ten digits may be assigned."""
    return number // 10**7 in AREA_AT and number // 10**4 % 1000 in AREA_AT


def date_of(text: str) -> tuple[datetime.date, str] | None:
    """The date that a text of ten characters writes, and its form."""
    forms = ["%Y-%m-%d"] if text[4] == "-" else [f"%d{text[2]}%m{text[5]}%Y"] + [f"%m{text[2]}%d{text[5]}%Y"] * (text[2] == "/")
    for form in forms:
        try:
            return datetime.datetime.strptime(text, form).date(), form
        except ValueError:
            pass
    return None


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for valid numbers."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))


def alphabet_of(c: str) -> str:
    for own in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in own:
            return own
    return ""


def spelled(text: str, tweak: bytes, key: bytes, back: bool, hexadecimal: bool = False) -> str:
    """Each digit and letter replaced by one of its kind, all as one number of mixed base."""
    kinds = [("0123456789abcdef" if text == text.lower() else "0123456789ABCDEF") if hexadecimal else alphabet_of(c) for c in text]
    value = size = 0
    size = 1
    for c, own in zip(text, kinds, strict=True):
        if own:
            value, size = value * len(own) + own.index(c), size * len(own)
    value, out = permuted(value, size, tweak, key, back), []
    for c, own in zip(reversed(text), reversed(kinds), strict=True):
        if own:
            value, digit = divmod(value, len(own))
            c = own[digit]
        out.append(c)
    return "".join(reversed(out))


def refilled(form: str, digits: str) -> str:
    """form with its digits and letters replaced, in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isalnum() else c for c in form)


def number(digits: str, tweak: bytes, key: bytes, back: bool) -> str:
    return str(permuted(int(digits), 10 ** len(digits), tweak, key, back)).zfill(len(digits))


@lru_cache(1 << 16)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or None if it isn't a valid one; back: the value of a pseudonym."""
    tweak = kind.encode()
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn(digits) % 10:
            return None
        body = number(digits[:-1], tweak, key, back)
        return refilled(text, body + str(-luhn(body + "0") % 10))
    if kind == "iban":
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
            return None
        body = spelled(plain[4:], tweak + plain[:2].encode(), key, back)
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        return refilled(text, f"{plain[:2]}{check:02d}{body}")
    if kind == "ip":
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        value = permuted(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, tweak, key, back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "phone":
        lead, value = len(digits) - 10, int(digits[-10:])
        if assigned(value):
            value = (AREA_AT[value // 10**7] * len(AREAS) + AREA_AT[value // 10**4 % 1000]) * 10**4 + value % 10**4
            value, line = divmod(permuted(value, len(AREAS) ** 2 * 10**4, tweak, key, back), 10**4)
            area, exchange = divmod(value, len(AREAS))
            return refilled(text, f"{digits[:lead]}{AREAS[area]}{AREAS[exchange]}{line:04d}")
        if not lead:
            return None
        return refilled(text, f"{digits[:lead]}{walked(value, 10**10, tweak, key, back, lambda x: not assigned(x)):010d}")
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        value = (((area - 1 - (area > 666)) * 99 + group - 1) * 9999) + serial - 1
        value, serial = divmod(permuted(value, 898 * 99 * 9999, tweak, key, back), 9999)
        area, group = divmod(value, 99)
        return refilled(text, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")
    if kind == "date":
        if (found := date_of(text)) is None or (text[4] != "-" and text[2] != text[5]):
            return None
        day, form = found
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        late = day.day > 12
        value = walked(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, tweak, key, back, lambda x: (datetime.date.fromordinal(FIRST_DAY + x).day > 12) == late)
        return datetime.date.fromordinal(FIRST_DAY + value).strftime(form)
    if kind == "email":
        local, _, host = text.rpartition("@")
        return f"{spelled(local, tweak + host.lower().encode(), key, back)}@{host}"
    return spelled(text, tweak, key, back, hexadecimal=True)


def at(text: str, start: int, pattern: re.Pattern, kind: str, key: bytes, back: bool) -> tuple[int, str, str] | None:
    """(end, kind, pseudonym) of a value of this kind that begins at start; of IBANs the longest valid one."""
    if not (match := pattern.match(text, start)):
        return None
    ends = [match.end()]
    if kind == "iban":
        ends += [i for i in range(match.end() - 1, start + 14, -1) if text[i] == " "]
    for end in ends:
        if (new := pseudonym(kind, text[start:end], key, back)) is not None:
            return end, kind, new
    return None


def first(text: str, start: int, match: re.Match, key: bytes, back: bool) -> tuple[int, str, str] | None:
    """The first kind that is valid where a match begins, from the match's own kind on."""
    kinds = [kind for kind, _ in EACH]
    for kind, pattern in EACH[kinds.index(match.lastgroup) :]:
        if found := at(text, start, pattern, kind, key, back):
            return found
    return None


def within(text: str, start: int, end: int, key: bytes, back: bool) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values in a run of digit groups that is no card as a whole."""
    out, pos = [], start
    while (match := OTHERS.search(text, pos)) and match.start() < end:
        new = pseudonym(match.lastgroup, match[0], key, back)
        if new is not None:
            out.append((match.start(), match.end(), match.lastgroup, new))
        pos = match.start() + 1 if new is None else match.end()
    groups = [m.span() for m in re.compile(r"\d+").finditer(text, start, end)]
    spans = []
    for i in range(len(groups)):
        sizes: tuple[int, ...] = ()
        for a, b in groups[i:]:
            sizes += (b - a,)
            if sum(sizes) > 19:
                break
            if sizes in SHAPES and luhn(re.sub(r"\D", "", text[groups[i][0] : b])) % 10 == 0:
                spans.append((-sum(sizes), groups[i][0], b))
    taken = [False] * (end - start)
    for a, b, _, _ in out:
        taken[a - start : min(b, end) - start] = [True] * (min(b, end) - a)
    for _, a, b in sorted(spans):
        if not any(taken[a - start : b - start]):
            taken[a - start : b - start] = [True] * (b - a)
            out.append((a, b, "card", pseudonym("card", text[a:b], key, back)))
    return sorted(out)


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it has."""
    seen: dict[str, int] = {}
    out, done, pos = [], 0, 0

    def put(start: int, end: int, kind: str, new: str) -> int:
        out.extend((text[done:start], new))
        seen[kind] = seen.get(kind, 0) + 1
        return end

    while match := FOUND.search(text, pos):
        start = match.start()
        if (new := pseudonym(match.lastgroup, match[0], key, back)) is not None:
            pos = done = put(start, match.end(), match.lastgroup, new)
        elif match.lastgroup == "card":
            pos = RUN.match(text, start).end()
            for a, b, kind, new in within(text, start, pos, key, back):
                done = put(a, b, kind, new)
            pos = max(pos, done)
        elif found := first(text, start, match, key, back):
            pos = done = put(start, *found)
        else:
            pos = start + 1
    return "".join([*out, text[done:]]), seen


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_values, and the count of each kind, for every row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                # a value has a digit, but for addresses, which have an @
                some = np.concatenate(([0], np.cumsum((texts.data == 64) | ((texts.data >= 48) & (texts.data <= 57)))))[texts.bounds]
                may, counts = np.flatnonzero(np.diff(some)), np.zeros((len(KINDS), texts.n), np.int32)
                changed, new = np.zeros(texts.n, bool), []
                for i in may:
                    text, seen = replaced(texts.raw(i).decode("utf-8", "replace"), key, back)
                    if seen:
                        changed[i] = True
                        new.append(text)
                        for kind, n in seen.items():
                            counts[KINDS.index(kind), i] = n
                own = batch.column(1).slice(texts.first, texts.n)
                if new:
                    own = pc.replace_with_mask(own, pa.array(changed), pa.array(new, own.type))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), own, pa.array(counts.sum(0).astype(np.int32)), *map(pa.array, counts)], names=["doc_id", "text", "n_values", *(f"n_{k}" for k in KINDS)])

    schema = "doc_id long, text string, n_values int, " + ", ".join(f"n_{k} int" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)
