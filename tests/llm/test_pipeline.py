"""Every stage of the pipeline beside brute force, on a small table and on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from test_mixing import reshared
from test_secret_scan import brute as base_secrets
from test_simhash import brute, slow_fingerprint
from zonalis.llm import bpe, language, secret_scan


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_stages_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "simhash_dedup", "secret_scan", "mix_sources", "bpe_encode"]
    at, frames = docs, []
    for name, f in cp.STAGES:
        at = cp.stored(f(spark, at, sf), name)
        frames.append(at)
        if name != names[-1]:
            assert at.columns == docs.columns
    rows = [f.collect() for f in frames]
    # 1: every rejected text has no clear language; this table has none such
    assert {r["doc_id"] for r in rows[0]} == before.keys()
    # 2: one of each component
    comp = brute({r["doc_id"]: slow_fingerprint(r["text"]) for r in rows[0]})
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(set(comp.values()))
    # 3: same documents, no secret left, texts without secrets unchanged
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(r["doc_id"] for r in rows[1])
    for r in rows[2]:
        text = before[r["doc_id"]]["text"]
        assert not base_secrets(r["text"]) and r["n_chars"] == len(r["text"])
        assert (r["text"] == text) == (not secret_scan.find(text))
    # 4: rows per source come near the targets, in whole documents
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows[2]:
        sizes[r["source"]] += words(r["text"])
        longest[r["source"]] = max(longest[r["source"]], words(r["text"]))
    for r in rows[3]:
        taken[r["source"]] += words(r["text"])
    assert set(map(tuple, rows[3])) <= set(map(tuple, rows[2]))
    assert max(Counter(r["doc_id"] for r in rows[3]).values()) <= 3
    for s, t in reshared(sizes).items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1
    # 5: ids of the library
    library = Tokenizer.from_file(bpe.default_tokenizer())
    mixed = Counter()
    for r in rows[3]:
        ids = np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4")
        mixed[r["doc_id"], hashlib.sha256(ids.tobytes()).hexdigest(), len(ids), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert mixed == Counter((r["doc_id"], r["ids_sha256"], r["n_tokens"], r["decoded_sha256"]) for r in rows[4])
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows[4])


ODD = [(1, "the old house by the river has a door", "en", "a", 37), (1, "the old house by the river has a door", "en", "a", 37),
       (None, "the old house by the river has a door", "en", None, None), (2, None, None, "a", None), (3, "", "en", "b", 0),
       (None, "das alte Haus am Fluss hat eine grosse Tuer", "de", None, 1), (None, "das alte Haus am Fluss hat eine grosse Tuer", "de", None, 1),
       (4, "-- 12 --", "en", "a", 8), (5, "word " * 30000, "en", "b", 150000), (6, "token=0123456789abcdef0123 in the house", "en", "b", 39)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "concat('mine ', doc_id) AS score", "'x' AS lang_pred", "'y' AS size", "'z' AS blob", "2 AS fp", "3 AS taken", "'k' AS _key",
        "named_struct('a', doc_id) AS target", "array(1, doc_id) AS `copies`", "'t' AS `_text`")
    at = docs
    for name, f in cp.STAGES:
        at = cp.stored(f(spark, at, ""), name)
        if name != "bpe_encode":
            assert at.columns == docs.columns
            for r in at.collect():
                assert r["score"] == (None if r["doc_id"] is None else f"mine {r['doc_id']}") and r["target"]["a"] == r["doc_id"]
                assert (r["lang_pred"], r["size"], r["blob"], r["fp"], r["taken"], r["_key"], r["_text"]) == ("x", "y", "z", 2, 3, "k", "t")
                assert r["copies"] == [1, r["doc_id"]]
        if rows and name == "simhash_dedup":
            assert sorted(str(r["doc_id"]) for r in at.collect()) == ["1", "5", "6", "None"]
    assert at.count() >= len(rows) // 3


def test_rejection_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in cp.language_id(spark, docs, "").collect()] == [1]
    assert language.UNKNOWN == "und"
