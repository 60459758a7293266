import hashlib
import string
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonalis.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tables():
    return al.pair(A, B)


def slow(texts):
    """Every document by comparing all of its token ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from zonalis.llm.bpe import byte_letters
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: x for x, c in byte_letters().items()}
    made = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            made.append(([], [], [], Counter()))
            continue
        ends = []
        for side in (bytes_a, bytes_b):
            at, e = 0, []
            for x in side:
                e.append((at, at + len(x)))
                at += len(x)
            ends.append(e)
        links = Counter((ids_a[i], ids_b[j]) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x[0] < y[1] and y[0] < x[1])
        groups, x, y = [], [], []
        i = j = 0
        while i < len(ids_a) or j < len(ids_b):
            if j == len(ids_b) or (i < len(ids_a) and ends[0][i][1] <= ends[1][j][1]):
                x.append(ids_a[i])
                i += 1
            else:
                y.append(ids_b[j])
                j += 1
            if x and y and i and j and ends[0][i - 1][1] == ends[1][j - 1][1]:
                groups.append((x, y))
                x, y = [], []
        made.append((ids_a, ids_b, groups, links))
    count = Counter(p for m in made for p in m[3])
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for ids_a, ids_b, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


ODD = ["", "a", " ", "  two  blanks ", "line\none\ttab", "naïve café 日本語 \U0001f600\U0001f600", "a▁b", "<|endoftext|> </s>", "don't isn't",
       "x" * 300, " nb sp   em", "é combined", "\u0000nul"]


ODD_CHARACTERS = st.text(st.sampled_from("ab1 é日'’,.!_-́²½\n\t\r\x1c\x85\xa0\u200b\u2009\u3000\ufeff<|endofx>") | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ODD_CHARACTERS)
def test_ids_are_those_of_the_files_own_library(text):
    from tokenizers import Tokenizer
    global OWN
    OWN = globals().get("OWN") or Tokenizer.from_file(A)
    OWN.encode_special_tokens = True
    for t in (text, text + "<|endoftext|>" + text):
        assert al.pair(A, B).a.encode([t])[0] == OWN.encode(" " + t, add_special_tokens=False).ids


def test_every_token_of_the_vocabulary_comes_back(tables):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    whole = [b.decode() for b in tables.a.bytes_of if b.decode("utf-8", "ignore").encode() == b]
    assert tables.a.encode(whole) == [e.ids for e in own.encode_batch([" " + w for w in whole], add_special_tokens=False)]


def rows_of(df):
    return sorted([tuple(r[c] for c in ("doc_id", *al.RESULTS)) for r in df.collect()], key=str)


@pytest.mark.parametrize("size,part", [(al.RANGE, al.PART), (40, 50)])
def test_same_as_comparing_all_ranges(spark, size, part):
    """Also with documents of many ranges and a table of pairs in many parts."""
    texts = [*ODD, None, "plain words and more of them, again and again; " * 12, "plain words", "plain words", "no-blank-" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_a", al.F.lit("mine"))
    got = rows_of(al.align(docs, A, B, size=size, part=part))
    assert got == sorted([(k, *r) for k, r in enumerate(slow([t or "" for t in texts]))], key=str)


def test_every_document_of_the_table(spark, sf):
    docs = al.table(spark, sf, "documents").select("doc_id", "text")
    texts = [r["text"] for r in docs.collect()]
    ids = [r["doc_id"] for r in docs.collect()]
    assert rows_of(al.op13_align(spark, sf)) == sorted([(k, *r) for k, r in zip(ids, slow([t or "" for t in texts]))], key=str)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (1, None), (1, "")], "doc_id long, text string")
    got = al.align(docs, A, B).collect()
    assert len(got) == 4 and sorted(r["n_a"] for r in got)[:2] == [0, 0]
    assert {(r["n_best"], r["count_sum"]) for r in got if r["n_a"]} == {(2, 4)}
    assert al.align(docs.limit(0), A, B).collect() == []
    with pytest.raises(ValueError):
        al.align(docs.withColumnRenamed("doc_id", "n_best"), A, B, key="n_best")


WORDS = st.lists(st.text(string.ascii_letters + "'.,-éß日́ \n\t", min_size=0, max_size=9), min_size=1, max_size=30).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(WORDS, st.integers(8, 60))
def test_ranges_give_the_tokens_of_the_whole(text, size):
    tables = al.pair(A, B)
    raw = (" " + text).encode()
    parts = [al.range_fragment(raw[s:e].decode(), s, low, high, tables) for s, e, low, high in al.ranges(raw, size)]
    f = parts[0]
    for p in parts[1:]:
        f = al.compose(f, p, tables)
    want = al.closed_texts([text], tables)[0]
    got = al.whole(f, tables)
    assert (got is None) == (want is None)
    if got:
        assert al._told(got) == al._told(want)


@settings(max_examples=60, deadline=None)
@given(st.text("ab cé日", min_size=3, max_size=60), st.data())
def test_compose_is_associative_wherever_it_is_cut(text, data):
    tables = al.pair(A, B)
    ids_a, ids_b, ok = tables.encode([text])
    t = al._tokens(tables, ids_a[0], ids_b[0])
    n = len((" " + text).encode())
    i, j = sorted(data.draw(st.lists(st.integers(0, n), min_size=2, max_size=2)))
    x, y, z = (al.fragment(t.within(p, q), tables) for p, q in ((0, i), (i, j), (j, n)))
    left = al.compose(al.compose(x, y, tables), z, tables)
    right = al.compose(x, al.compose(y, z, tables), tables)
    assert al._written(0, 0, left) == al._written(0, 0, right)
    if ok[0]:
        assert al._told(al.whole(left, tables)) == al._told(al.closed_texts([text], tables)[0])
