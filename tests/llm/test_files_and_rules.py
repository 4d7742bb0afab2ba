"""Token shards, licences and pseudonyms."""

import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import licences, pseudonyms, token_shards
from lodestone.llm.batches import Texts
from lodestone.llm.queries import KEY, vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


ODD = ["don't I'LL", "x<|endoftext|>y  z", "a\x00b \x85c", "a\x1cb c\x1dd", "café éx", "ΑΣ ΑΣΣ Σ", "İstanbul K Å", "ok​zz 12345 ½ ①", "a　b", "?'s 'sam", ""]


def test_encoder_is_the_tokenizer(tokenizer, awkward):
    encoder = token_shards.Encoder(vocabulary(), 2)
    for text in [*ODD, *(r[1] or "" for r in awkward)]:
        assert encoder.encode(text.encode()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_with_little_memory(tokenizer, awkward, monkeypatch):
    monkeypatch.setattr(token_shards, "REMEMBERED", 5)
    encoder = token_shards.Encoder(vocabulary(), 2)
    for text in (r[1] or "" for r in awkward):
        assert encoder.encode(text.encode()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_shards(spark, docs, awkward, tokenizer, tmp_path):
    got = sorted(token_shards.export(docs, vocabulary(), folder=f"file://{tmp_path}/s").collect(), key=lambda r: r["start"])
    ids = sorted(((r[0] is not None, r[0] or 0), [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in awkward)
    at = 0
    assert [r["doc_id"] for r in got] == [k[1] if k[0] else None for k, _ in ids]
    for r, (_, own) in zip(got, ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    readers = [token_shards.Reader(str(p)) for p in sorted((tmp_path / "s").glob("*.sst"))]
    for doc_id in {r[0] for r in awkward}:
        want = sorted(own for k, own in ids if k == (doc_id is not None, doc_id or 0))
        assert sorted(x.tolist() for reader in readers for x in reader.get(doc_id)) == want
    assert not any(reader.get(10**12) for reader in readers)


def test_no_shards_of_nothing(none):
    assert token_shards.export(none, vocabulary()).count() == 0


def test_many_blocks(tmp_path):
    writer = token_shards.Writer(str(tmp_path / "x.sst"))
    for i in range(-500, 500):
        writer.add(token_shards.key_of(i), np.arange(abs(i) * 7 % 300, dtype=np.uint32) + 60000)
    writer.close()
    reader = token_shards.Reader(str(tmp_path / "x.sst"))
    assert len(reader.index) > 5 and [token_shards.id_of(k) for k, _, _ in reader.entries()] == list(range(-500, 500))
    assert all(len(reader.get(i)[0]) == abs(i) * 7 % 300 for i in (-500, -1, 0, 499))


def test_licences(spark):
    mit = f"Intro. {licences.SENTENCES['mit-grant']} {licences.SENTENCES['mit-keep']}\n{licences.SENTENCES['asis-software']}"
    texts = {1: "Licensed under CC BY-NC 4.0.", 2: mit, 3: None, 4: "", 5: "no terms", 6: "Released under the  MIT License.\nreleased under THE MIT license!", 7: licences.SENTENCES["apache-comply"], 8: "word " * 30000 + "\nLicensed under the Apache License, Version 2.0."}
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, texts[1], "x")], "doc_id long, text string, licences string")
    got = [(r["doc_id"], r["licences"], r["n_sentences"], r["left_over"]) for r in licences.scan(rows).orderBy("doc_id").collect()]
    assert got == [(1, "CC-BY-NC-4.0", 1, ""), (1, "CC-BY-NC-4.0", 1, ""), (2, "MIT", 3, ""), (3, "", 0, ""), (4, "", 0, ""), (5, "", 0, ""), (6, "MIT", 2, ""), (7, "", 1, "apache-comply"), (8, "Apache-2.0", 1, "")]


def test_longer_rules_come_first(spark):
    two = " ".join(licences.SENTENCES[k] for k in ("bsd-intro", "bsd-source", "bsd-binary"))
    rows = spark.createDataFrame([(1, two), (2, f"{two} {licences.SENTENCES['bsd-names']}")], "doc_id long, text string")
    assert [r["licences"] for r in licences.scan(rows).orderBy("doc_id").collect()] == ["BSD-2-Clause", "BSD-3-Clause"]


def test_no_licences_of_nothing(none):
    assert licences.scan(none).count() == 0


VALUES = {"card": "4111 1111-1111 1111", "iban": "DE89 3704 0044 0532 0130 00", "ip": "23.4.5.6", "phone": "+1 (917) 555-7713", "ssn": "123-45-6789", "date": "2024-02-29", "email": "und.34@mail7.example.com", "secret": "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"}


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_the_format_and_invert(kind):
    value = VALUES[kind]
    new = pseudonyms.pseudonym(kind, value, KEY)
    assert new != value and new == pseudonyms.pseudonym(kind, value, KEY) and pseudonyms.pseudonym(kind, new, KEY, back=True) == value
    if kind != "ip":
        assert [c.isalnum() for c in new] == [c.isalnum() for c in value]
    text, seen = pseudonyms.replaced(f"see {value}, and {value}.", KEY)
    assert text == f"see {new}, and {new}." and seen == {kind: 2}


def test_what_is_not_valid_stays():
    for text in ("4111 1111 1111 1112", "999.1.1.1", "2023-02-29", "000-12-3456", "DE00 3704 0044 0532 0130 00", "31.02.1999", "12345"):
        assert pseudonyms.replaced(text, KEY) == (text, {})


@pytest.mark.parametrize("size", [1, 2, 7, 10, 1000])
def test_permutation(size):
    out = [pseudonyms.permuted(i, size, b"t", b"k") for i in range(size)]
    assert sorted(out) == list(range(size)) and [pseudonyms.permuted(x, size, b"t", b"k", True) for x in out] == list(range(size))


def test_pseudonymised_table(spark, none):
    rows = [(1, "ip 23.4.5.6 here"), (2, None), (3, ""), (4, "ip 23.4.5.6 here"), (5, "plain " * 30000 + "23.4.5.6"), (None, "x")]
    got = pseudonyms.pseudonymised(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_values int"), KEY).collect()
    by = {r["doc_id"]: r for r in got}
    new = pseudonyms.pseudonym("ip", "23.4.5.6", KEY)
    assert by[1]["text"] == by[4]["text"] == f"ip {new} here" and by[5]["text"].endswith(new) and by[5]["n_ip"] == 1
    assert by[2]["text"] is None and by[3]["text"] == "" and by[None]["text"] == "x"
    assert pseudonyms.pseudonymised(none, KEY).count() == 0


def test_shards_are_read_without_an_encoder(tmp_path):
    """A worker that goes on to other stages keeps no vocabulary and no words."""
    path = str(tmp_path / "part-000000.sst")
    writer = token_shards.Writer(path)
    writer.add(token_shards.key_of(7), token_shards.encoder(vocabulary(), 2, 10).encode(b"some words"))
    writer.close()
    assert token_shards._encoders
    assert [b.column("doc_id").to_pylist() for b in token_shards.entries(path, 0)] == [[7]] and not token_shards._encoders


def test_words_of_known_parts_are_not_encoded_again():
    """New words that differ in case or in the marks behind them have no part that is new."""
    encoder, known = token_shards.Encoder(vocabulary(), 2), ["river", "stone", "émile", "'s", ",", ".", "***", "7"]
    encoder.encode(" ".join(known).encode())
    encoder.encode(" ".join(f"{a}{b}{c}" for w in known[:3] for a in (w, w.title(), w.upper()) for b in ("", "'s", "7") for c in (",", ".", "***")).encode())
    assert len(encoder.place) == len(known)


def test_texts_of_one_piece_are_told_apart(tokenizer, awkward):
    texts = [*ODD, "don", "'t", "<", "|endoftext|>", "a’b c“", "12", "34", *(r[1] or "" for r in awkward)]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    for remembered in (5, 500):
        ids, begin = token_shards.Encoder(vocabulary(), 2, remembered).encode_all(Texts(0, np.frombuffer(b"".join(raw), np.uint8), bounds))
        assert [ids[i:j].tolist() for i, j in zip(begin, begin[1:])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("change", ["normalizer", "pre_tokenizer", "added_tokens"])
def test_other_vocabularies(tmp_path, change):
    with open(vocabulary()) as f:
        form = json.load(f)
    form[change] = {"normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "added_tokens": [form["added_tokens"][0] | {"content": "stone"}]}[change]
    (tmp_path / "v.json").write_text(json.dumps(form))
    other, encoder = Tokenizer.from_file(str(tmp_path / "v.json")), token_shards.Encoder(str(tmp_path / "v.json"), 2)
    for text in [*ODD, "The River's stones", "  7 stones"]:
        assert encoder.encode(text.encode()).tolist() == [*other.encode(text, add_special_tokens=False).ids, 2]
