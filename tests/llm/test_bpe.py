"""Encoding beside the tokenizers library, and exact round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from zonalis.llm import bpe

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.encoder(PATH)


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab'stdl0\x1c\x85\xa0é文😀²"), st.characters(codec="utf-8")), max_size=30))
def test_as_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b  <|endoftext|>", "x" * 3000, "ab " * 5000, "\r\n\r\n  x  ", "don't we'll"])
def test_edges(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a\xa0b\xa0c \xa0 \xa0 \xa0d", "a\tb\tc  d \te", "a\u3000b\u2003c  d", "a\x85b  c", "a\rb\x1cc   d", "a\tb "])
def test_single_rare_spaces_beside_runs(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.blanks(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab  \n" + bpe.SPACES_WIDE), min_size=1, max_size=12))
def test_blanks_as_defined(text):
    beside = f" {text} "
    assert bpe.blanks(text) == any(c == " " and (beside[k].isspace() or beside[k + 2].isspace()) for k, c in enumerate(text))


def test_all_white_space_is_listed():
    assert sorted(bpe.SPACES_WIDE) == [chr(k) for k in range(0x110000) if chr(k).isspace()]


def test_cache_eviction_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    e = bpe.Encoder(PATH)
    text = " ".join(f"w{k % 7}x." for k in range(300))
    assert np.frombuffer(e.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_with_marks_take_no_room_of_words():
    e = bpe.Encoder(PATH)
    merged = []
    merge, e.merge = e.merge, lambda word: merged.append(word) or merge(word)
    text = "x rhinoceros, rhinoceros. rhinoceros!! (rhinoceros) rhinoceros?\nrhinoceros rhinoceros's rhinoceros"
    assert np.frombuffer(e.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert merged.count(b" rhinoceros") == 1
    assert [p for p in e.after_blank if p.startswith("rhinoceros")] == ["rhinoceros", "rhinoceros's"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abéß文'" + bpe.MARKS + "\n1²"), min_size=1, max_size=8), max_size=6))
def test_marks_behind_words(pieces):
    text = " ".join(pieces)
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 66, 16384, 16385, 40000])
@pytest.mark.parametrize("part", ["a", "éa", "tion", "-=", "文"])
def test_words_of_any_length(n, part):
    text = (part * n).encode()[:n].decode(errors="ignore")
    for t in (text, " " + text):
        assert ids(t) == LIBRARY.encode(t, add_special_tokens=False).ids


def test_letters_and_marks_are_classes_of_the_pattern():
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            assert OWN.pretokens(f" {c}a") == [f" {c}a"]
    assert OWN.pretokens(f" a{bpe.MARKS}") == [" a", bpe.MARKS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, max(OWN.bytes_of)).filter(OWN.bytes_of.__contains__), max_size=40))
def test_own_ids_are_decoded_as_any(some):
    assert OWN.decode_own(np.array(some, "<i4")) == OWN.decode(some)


def test_own_ids_are_decoded_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "DECODED", 3)
    text = "Größe 文字 and tokens\n" * 5
    assert OWN.decode_own(np.frombuffer(OWN.encode(text), "<i4")) == text


def test_rows(spark):
    rows = [(1, "Hello  world", "a"), (1, "Hello  world", "a"), (None, None, None), (2, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.round_trip(docs, PATH).collect(), key=str)
    assert len(got) == 4
    for r in got:
        t = r["text"] or ""
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    both = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert {(r["text"] or "", r["decoded"]) for r in both.collect()} == {("Hello  world",) * 2, ("", "")}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_whole_table(spark, sf):
    got = {r["doc_id"]: r for r in bpe.op2_bpe(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
