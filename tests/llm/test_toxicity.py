import math
import re
from collections import Counter

import numpy as np
import pytest

from zonalis.llm import toxicity as tx
from zonalis.llm.common import held_out, table


def terms_of(text):
    """Words, their beginnings, and marks of both for being there often, with their numbers."""
    seen = Counter()
    for w in re.findall(r"\w+", (text or "").lower()):
        seen[w] += 1
        for k in (4, 5, 6, 7, 8):
            if len(w) > k:
                seen["^" + w[:k]] += 1
    return seen | Counter(f"{w}#{b}" for w, n in seen.items() for b in (2, 3, 5, 8) if n >= b)


def slow_terms(sample):
    """Terms by their 2 x 2 tables."""
    n = Counter(y for _, y, _ in sample)
    seen = {0: Counter(), 1: Counter()}
    for _, y, t in sample:
        seen[y].update(set(terms_of(t)))
    out = []
    for w in seen[0].keys() | seen[1].keys():
        cells = [(seen[y][w], n[y] - seen[y][w]) for y in (0, 1)]
        rows, cols, all_ = [sum(c) for c in cells], [cells[0][k] + cells[1][k] for k in (0, 1)], sum(map(sum, cells))
        g = 2 * sum(x * math.log(x * all_ / (rows[i] * cols[k])) for i, c in enumerate(cells) for k, x in enumerate(c) if x)
        if abs(seen[1][w] / n[1] - seen[0][w] / n[0]) >= tx.MARGIN and g >= tx.SURE:
            out.append((-g, w))
    return [w for _, w in sorted(out)][:tx.TERMS]


def slow(docs, sample, n):
    """Scores by dense vectors and every example; sample: (key, label, text)."""
    terms = slow_terms(sample)
    at = {w: k for k, w in enumerate(terms)}
    df = Counter(w for _, t in docs for w in set(terms_of(t)) if w in at)
    idf = [math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in terms]

    def vector(t):
        v = np.zeros(len(terms))
        for w, m in terms_of(t).items():
            if w in at:
                v[at[w]] = (1 + math.log(m)) * idf[at[w]]
        size = math.sqrt(v @ v)
        return v / size if size else v

    taken = Counter(y for _, y, _ in sample)
    share = np.array([n[y] / taken[y] for y in (0, 1)])
    known = [(str(k), y, vector(t)) for k, y, t in sample]

    def vote(key, v):
        near = sorted((-round(float(v @ x), 12), k, y) for k, y, x in known if k != str(key) and v @ x > 0)[:tx.NEAREST]
        if not near:
            return None
        w = [share[y] / (max(0.0, 1 + c) + tx.SOFT) for c, _, y in near]
        return sum(a * y for a, (_, _, y) in zip(w, near)) / sum(w)

    told = [(vote(k, v), y) for k, y, v in sorted(known, key=lambda x: x[:2])]
    bare = tx.rate([y for v, y in told if v is None], share)
    votes, scores = tx.isotonic([(v, y) for v, y in told if v is not None], share)
    return [bare if (v := vote(k, vector(t))) is None else float(np.interp(v, votes, scores)) for k, t in docs]


def test_same_as_comparing_every_example(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").where(~held_out("doc_id")).collect() if r["toxic"] is not None}
    sample = [(k, marks[k], t) for k, t in docs if k in marks]
    want = slow(docs, sample, Counter(marks[k] for k, _, _ in sample))
    got = {r["doc_id"]: r for r in tx.op11_toxicity(spark, sf).collect()}
    assert len(got) == len(docs)
    assert [got[k]["score"] for k, _ in docs] == pytest.approx(want, abs=1e-9)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_held_out_documents(spark):
    """Most toxic documents are found in every language, hardly a clean one is taken for toxic."""
    sf = "/root/testdata/sf0.1"
    rows = tx.op11_toxicity(spark, sf).join(table(spark, sf, "labels").where("toxic IS NOT NULL AND quality = 1"), "doc_id").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 400
    for lang in ("en", "de", "fr", "es"):
        toxic, clean = ([r["predicted"] for r in rows if r["lang"] == lang and r["toxic"] == y] for y in (1, 0))
        assert sum(toxic) >= 0.8 * len(toxic) > 0
        assert sum(clean) <= 0.03 * len(clean)
    assert all(any(x["label"] == 1 for x in r["nearest"]) and r["terms"] for r in rows if r["predicted"])


def test_blocks_are_skipped_and_the_nearest_exact():
    r = np.random.default_rng(5)
    rows = []
    for k in range(900):
        t = sorted({*r.choice(6, 2, replace=False).tolist(), *(6 + r.choice(40, 3, replace=False)).tolist()})
        rows.append((f"{k:04d}", int(t[0] < 2), t, r.integers(1, 5, len(t)).tolist()))
    idf = np.r_[np.full(6, 5.0), np.full(40, 1.1)]
    index = tx.index_of(rows, idf, np.ones(2))
    read = []
    for k, _, t, n in rows[::37]:
        seen = []
        found, cosines = index.nearest(t, n, k, seen=seen)
        read.append(len(seen) / index.n_blocks)
        w = np.zeros(46)
        w[t] = index.weights(t, n)
        want = []
        for k2, _, t2, n2 in rows:
            v = np.zeros(46)
            v[t2] = index.weights(t2, n2)
            if k2 != k and v @ w > 0:
                want.append((-round(float(v @ w), 12), k2))
        assert [index.keys[i] for i in found] == [x for _, x in sorted(want)[:tx.NEAREST]]
    assert np.mean(read) < 0.7


def test_defined_cases(spark):
    bad, good = "you utter fool of a fool", "the weather is mild today"
    rows = [(i, bad if i % 2 else good, 1) for i in range(60)] + [(60, None, 1), (61, "", 1), (None, bad, 1), (7, bad, 1), (62, good + " " + "mild " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 40)] + [(999, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = tx.score(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[41]["predicted"] == 1 and by[42]["predicted"] == 0 and by[62]["predicted"] == 0 and by[None]["predicted"] == 1
    assert by[60]["score"] == by[61]["score"] and 0 <= by[60]["score"] <= 1 and by[60]["terms"] == []
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    assert all(x["key"] != "5" for x in by[5]["nearest"])
    assert {r["score"] for r in tx.score(docs, marks.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in tx.score(docs, marks.where("toxic = 1")).collect()} == {1.0}
    assert tx.score(docs.limit(0), marks).collect() == []
    with pytest.raises(ValueError):
        tx.score(docs, marks, key="score")
