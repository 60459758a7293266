"""Held-out accuracy, the pair model and the defined cases."""

import numpy as np

from zonalis.llm import quality as ql


def test_ranking_by_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(ql.FEATURES)))
    x[:, 3] = 5.0                                          # a feature that says nothing
    truth = x @ np.r_[2.0, -1.0, np.zeros(len(ql.FEATURES) - 2)]
    r = ql.bradley_terry(x[truth > 0], x[truth <= 0])
    s = r.score(x)
    assert np.corrcoef(s, truth)[0, 1] > 0.98 and (s[truth > 1].min() > s[truth < -1].max())
    # at the optimum, no small change of the weights lowers the loss of the pairs
    g, b = (x[truth > 0] - r.mean) / r.scale, (x[truth <= 0] - r.mean) / r.scale
    n = max(len(g), len(b)) * ql.PARTNERS
    k = np.arange(n)
    d = g[k % len(g)] - b[(k + k // max(len(g), len(b)) * 7919) % len(b)]
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + ql.RIDGE / 2 * w @ w
    w = np.array(r.weights)
    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=len(w))) for _ in range(40))


def test_cut_is_a_quantile_of_all_scores():
    assert 3 <= ql.cut([1, 2, 3, 4, 5, 6], [5] * 6, np.array([5.5, 6.0]), np.array([1.0, 2.5])) <= 5
    assert ql.cut([0.0], [9], np.array([1.0]), np.array([1.0])) == 0.0


def test_features_of_any_text():
    for t in (None, "", " \n", "a", "\x00", "é", "x" * 100_000, "| | |", "1 2 3"):
        f = ql.features(t)
        assert len(f) == len(ql.FEATURES) and np.isfinite(f).all()


def test_defined_cases(spark):
    good = [(k, f"The house number {'abcdefghij'[k % 10]} is old. It has a door, and a garden.", "x") for k in range(40)]
    bad = [(100 + k, "buy%%% now&&& %%% " * (3 + k % 5), "x") for k in range(40)]
    docs = spark.createDataFrame([*good, *bad, (None, None, None), (500, "", "x"), (1, good[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(40)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    got = ql.score(docs, labels).collect()
    assert len(got) == 83 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["predicted"] == (r["doc_id"] < 100) for r in got if r["doc_id"] is not None and r["doc_id"] < 500)
    same = {r["score"] for r in got if r["doc_id"] == 1}
    assert len(same) == 1
    one = ql.score(docs, labels.where("quality = 1")).collect()
    assert {(r["score"], r["predicted"]) for r in one} == {(0.5, 1)}
    assert ql.score(docs.limit(0), labels).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in ql.op1_quality(spark, sf).collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [k for k in truth if k in got and got[k]["held_out"]]
    assert len(got) == 1000 and len(held) > 40
    assert sum(got[k]["predicted"] == truth[k] for k in held) / len(held) > 0.95
