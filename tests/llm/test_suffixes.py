"""Suffix arrays beside sorting, removals beside a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from zonalis.llm import suffixes as sx


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(0, 40), 100, 301, 1000]:
        for top in (1, 2, 4, 200):
            s = rng.integers(1, top + 1, n)
            assert sx.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    big = rng.integers(1, 1 << 40, 50)
    assert sx.suffix_array(big).tolist() == sorted(range(50), key=lambda i: big[i:].tolist())


def test_units_tile_the_windows_and_follow_content(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 101, 3000, dtype=np.uint8))

    def windows(t):
        out = {}
        for g, _, first, at, count in sx.units(t):
            for k in range(len(g)):
                for j in range(count[k]):
                    out[int(first[k] + j)] = (int(g[k]), int(at[k] - j))
        return out
    whole = windows(text)
    assert sorted(whole) == list(range(len(text) - 99))
    moved = windows(b"x" * 777 + text[500:1500])
    assert all(moved[777 + k] == whole[500 + k] for k in range(901))
    monkeypatch.setattr(sx, "PIECE", 512)
    assert windows(text) == whole


def brute(rows):
    """Per row: removed intervals, from the earliest (id, start) of every window."""
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            w = b[k:k + 100]
            at = (*key(i), k)
            if w not in first or at < first[w]:
                first[w] = at
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [(k, k + 100) for k in range(len(b) - 99) if first[b[k:k + 100]] < (*key(i), k)]
        out.append(sx.union_of(gone))
    return out


def agrees(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS removed")
    got = sorted((str(r["doc_id"]), r["text"] or "", [tuple(x) for x in r["removed"]], bytes(r["kept"])) for r in sx.dedup(df).collect())
    want = []
    for (i, t), cut in zip(rows, brute(rows)):
        b = (t or "").encode()
        want.append((str(i), t or "", cut, bytes(x for k, x in enumerate(b) if not any(a <= k < e for a, e in cut))))
    assert got == sorted(want)
    return want


@pytest.mark.parametrize("block, often", [(4096, 16), (2, 2)])
def test_odd_rows(spark, monkeypatch, block, often):
    from zonalis.llm import common
    monkeypatch.setattr(sx, "blocked_pairs", lambda df, keys, spread: common.blocked_pairs(df, keys, spread, block))
    monkeypatch.setattr(sx, "OFTEN", often)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for k in range(14):                                    # copies with an edit here and there
        t = passage
        for _ in range(r.randint(0, 4)):
            p = r.randrange(len(t))
            t = t[:p] + r.choice("xyz") + t[p + r.randint(0, 2):]
        rows.append((k, word() * r.randint(0, 3) + t + word()))
    rows += [(20, passage), (21, passage), (21, passage), (21, passage[3:] + "!"), (None, passage[:150]), (None, passage[40:]), (22, None), (23, ""),
             (24, passage[:99]), (25, "ab" * 400), (26, "z" * 700), (27, passage[:130] + passage[20:160]), (-5, passage[10:140]), (28, "é" * 130)]
    want = agrees(spark, rows)
    assert sum(len(x[2]) for x in want) > 15


def test_empty(spark):
    assert sx.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in sx.op6_suffixes(spark, sf).collect()}
    assert len(got) == len(rows)
    for (i, t), cut in zip(rows, brute(rows)):
        b = t.encode()
        ends = [0, *[x for ab in cut for x in ab], len(b)]
        kept = b"".join(b[x:y] for x, y in zip(ends[::2], ends[1::2]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), sum(y - x for x, y in cut), len(cut))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_a_gram_often_met_in_one_place_and_once_in_another(spark, monkeypatch):
    """The single place is a repeat too, whatever the salt of the many."""
    monkeypatch.setattr(sx, "OFTEN", 2)
    monkeypatch.setattr(sx, "SALTS", 1000)
    r = random.Random(3)
    for trial in range(3):
        passage = "".join(r.choice("abcdefgh ") for _ in range(260))
        many = [(k, passage) for k in range(3)]
        df = spark.createDataFrame(many, "doc_id long, text string").coalesce(1).union(
            spark.createDataFrame([(9, "xyz" + passage)], "doc_id long, text string").coalesce(1))
        got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in sx.dedup(df).collect()}
        assert got == {0: [], 1: [(0, 260)], 2: [(0, 260)], 9: [(3, 263)]}
